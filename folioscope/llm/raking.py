"""Mixing sources to target weights by iterative proportional fitting.

Tokens are added up per cell (source, language, topic). Cell weights are raked until their sums match
the targets of each dimension, and documents are drawn with the probability that gives their cell its
weight, decided by a hash of the id.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.session import discard, durable

DIMENSIONS = ("source", "lang", "topic")
#: Raking ends when no marginal is further than this part from its target.
TOLERANCE = 1e-6
MAX_ROUNDS = 200
#: Up to so many cells are raked and told as one small table; more stay in Spark.
CELLS_TOLD = 100_000
#: Pieces of a cell's documents when the cells are too many to be told.
SALTS = 32

#: Target shares by value, or a power: shares in proportion to each value's tokens raised to it (1 keeps the mix, 0 makes values equal).
Targets = dict[str, dict[str, float] | float]


def topic_of(text: Column) -> Column:
    """A document's topic by its form: licence, table, noise, capitals or prose."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(F.regexp_like(text, F.lit(r"(?i)\blicen[cs]e\b")), "licence")
        .when(F.regexp_count(text, F.lit(r" \| ")) * 40 > F.length(text), "table")
        .when(F.regexp_count(text, F.lit(r"[#$%&*]{3}")) * 40 > F.length(text), "noise")
        .when(F.regexp_count(text, F.lit(r"\p{Lu}")) * 3 > F.length(text), "capitals")
        .when(F.length(text) < 400, "short prose")
        .otherwise("prose")
    )


def n_words(text: Column) -> Column:
    """Words (runs of anything but blanks) of the whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _same(left: DataFrame, right: DataFrame, names: dict[str, str]) -> Column:
    out = F.lit(True)
    for a, b in names.items():
        out = out & left[a].eqNullSafe(right[b])
    return out


def with_targets(cells: DataFrame, targets: Targets) -> DataFrame:
    """``cells`` with a column ``_t_<dimension>`` of target shares, which add up to 1 over the values that have tokens."""
    spark, out = cells.sparkSession, cells
    for d, target in targets.items():
        sums = cells.groupBy(d).agg(F.sum("tokens").alias("_n")).where("_n > 0")
        if isinstance(target, dict):
            given = spark.createDataFrame([(k, float(v)) for k, v in target.items()], "_v string, _s double")
            shares = sums.join(given, _same(sums, given, {d: "_v"})).select(F.col(d).alias("_v"), "_s")
        else:
            shares = sums.select(F.col(d).alias("_v"), F.pow(F.col("_n").cast("double"), F.lit(float(target))).alias("_s"))
        shares = shares.where("_s > 0")
        total = shares.agg(F.sum("_s").alias("_all"))
        shares = shares.crossJoin(F.broadcast(total)).select("_v", (F.col("_s") / F.col("_all")).alias(f"_t_{d}"))  # one row
        out = out.join(shares, _same(out, shares, {d: "_v"}), "left").drop("_v")
    return out


def _raked_here(cells: DataFrame, dimensions: list[str], tolerance: float, rounds: int) -> DataFrame:
    rows = cells.orderBy(*dimensions).toArrow()
    codes = [np.unique([repr(v) for v in rows[d].to_pylist()], return_inverse=True)[1] for d in dimensions]
    shares = [np.bincount(c, np.array(rows[f"_t_{d}"].to_pylist(), np.float64)) / np.bincount(c) for c, d in zip(codes, dimensions, strict=True)]
    weight = np.array(rows["weight"].to_pylist(), np.float64)
    for _ in range(rounds):
        worst = max(np.abs(np.bincount(c, weight, len(s)) - s).max() for c, s in zip(codes, shares, strict=True)) if len(weight) else 0
        if worst <= tolerance:
            break
        for c, s in zip(codes, shares, strict=True):
            now = np.bincount(c, weight, len(s))
            weight = weight * np.divide(s, now, out=np.zeros(len(s)), where=now > 0)[c]
    rows = rows.drop_columns(["weight"]).to_pandas()
    rows["weight"] = weight
    return cells.sparkSession.createDataFrame(rows, cells.select(*rows.columns).schema)


def _raked_there(cells: DataFrame, dimensions: list[str], tolerance: float, rounds: int) -> DataFrame:
    state = durable(cells)
    for _ in range(rounds):
        if max((marginal_gap(state, d) for d in dimensions), default=0) <= tolerance:
            break
        after = state
        for d in dimensions:
            now = after.groupBy(F.col(d).alias("_v")).agg(F.sum("weight").alias("_w"))
            factor = F.when(F.col("_w") > 0, F.col(f"_t_{d}") / F.col("_w")).otherwise(0.0)
            after = after.join(now, _same(after, now, {d: "_v"})).withColumn("weight", F.col("weight") * factor).drop("_v", "_w")
        after = durable(after)
        discard(state)
        state = after
    return state


def marginal_gap(raked: DataFrame, dimension: str) -> float:
    """How far the weights' sum of any value of ``dimension`` is from its target share ``_t_<dimension>``, at most."""
    sums = raked.groupBy(dimension, f"_t_{dimension}").agg(F.sum("weight").alias("_w"))
    return sums.agg(F.max(F.abs(F.col("_w") - F.col(f"_t_{dimension}")))).first()[0] or 0.0


def rake(cells: DataFrame, targets: Targets, tolerance: float = TOLERANCE, rounds: int = MAX_ROUNDS, cells_told: int = CELLS_TOLD) -> DataFrame:
    """``cells`` (dimensions, tokens) with ``weight``, adding up to 1: token shares scaled until every marginal is its target.

    A cell without tokens, or with a value that has no target, gets weight 0; a target of no cell is
    left out and the others share its part. If the targets contradict each other, the weights after
    ``rounds`` rounds are returned; they match the last dimension, and a warning tells by how much the
    others miss theirs. Few cells are raked on the driver,
    many in Spark by sums per value; both give the same weights.
    """
    dimensions = list(targets)
    given = with_targets(cells, targets)
    usable = F.col("tokens") > 0
    for d in dimensions:
        usable = usable & F.col(f"_t_{d}").isNotNull()
    counted = durable(given.withColumn("weight", F.when(usable, F.col("tokens").cast("double"))))
    total = counted.agg(F.sum("weight")).first()[0]
    live = counted.where("weight is not null").withColumn("weight", F.col("weight") / F.lit(total or 1.0))
    raked = (_raked_here if counted.count() <= cells_told else _raked_there)(live, dimensions, tolerance, rounds)
    raked = durable(raked)
    gap = max((marginal_gap(raked, d) for d in dimensions), default=0.0)
    if gap > tolerance:
        warnings.warn(f"raking ended after {rounds} rounds with a marginal {gap:.3g} from its target: the targets contradict each other or converge slowly", stacklevel=2)
    rest = counted.where("weight is null").withColumn("weight", F.lit(0.0))
    return raked.select(*cells.columns, "weight").union(rest.select(*cells.columns, "weight"))


def rates(cells: DataFrame, keep: float) -> DataFrame:
    """``cells`` (tokens, weight) with ``probability``: in proportion to weight / tokens, at most 1, for ``keep`` of all tokens in expectation.

    Where a cell can't give its share even whole, the others give more; if all can't, everything with a
    weight is kept.
    """
    rate = F.col("weight") / F.col("tokens")
    wanted = keep * (cells.agg(F.sum("tokens")).first()[0] or 0)
    scale, before = 0.0, -1.0
    while scale != before:  # each step can only add cells to those kept whole
        before = scale
        whole = F.lit(scale) * rate >= 1
        held, free = cells.where("weight > 0").agg(F.sum(F.when(whole, F.col("tokens")).otherwise(0)), F.sum(F.when(whole, 0.0).otherwise(F.col("weight")))).first()
        if not free:
            scale = before if before > 0 else 1.0
            break
        scale = max(scale, (wanted - held) / free)
    return cells.withColumn("probability", F.when(F.col("weight") > 0, F.least(F.lit(1.0), F.lit(scale) * rate)).otherwise(0.0))


def _described(docs: DataFrame, id_column: str, text_column: str, dimensions: dict[str, str], seed: int) -> DataFrame:
    """``docs`` with ``_u`` in [0, 1) by the id and text, and the dimensions, by their columns, as strings ``_d_<dimension>``."""
    key = F.xxhash64(F.lit(seed), F.col(id_column).cast("string"), F.crc32(F.coalesce(F.col(text_column), F.lit("")).cast("binary")))
    out = docs.withColumn("_u", F.shiftrightunsigned(key, 11).cast("double") / F.lit(float(1 << 53)))
    for d, column in dimensions.items():
        out = out.withColumn(f"_d_{d}", (topic_of(F.col(text_column)) if d == "topic" else F.col(column)).cast("string"))
    return out


def _with_rates(described: DataFrame, rated: DataFrame, dimensions: list[str]) -> DataFrame:
    """Add ``weight`` and ``probability`` of each row's cell."""
    cells = rated.select(*(F.col(d).alias(f"_c_{d}") for d in dimensions), "weight", "probability")
    names = {f"_d_{d}": f"_c_{d}" for d in dimensions}
    if rated.count() <= CELLS_TOLD:
        joined = described.join(F.broadcast(cells), _same(described, cells, names))
    else:  # a cell may hold a third of all rows: deal it out
        salted = described.withColumn("_salt", F.pmod(F.hash("_u"), F.lit(SALTS)))
        copies = cells.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(copies, _same(salted, copies, {**names, "_salt": "_part"}))
    return joined


def mixed(
    docs: DataFrame, targets: Targets, keep: float, id_column: str = "doc_id", text_column: str = "text", seed: int = 3,
) -> DataFrame:
    """One row per document: (doc_id, source, lang, topic, n_tokens, weight, probability, kept).

    ``targets`` names the dimensions: columns of ``docs``, or ``topic``, which follows from the whole text. Null is
    a value of its own, which only a power can give a target. A document is kept if a number in [0, 1) hashed from its id and text is less
    than its cell's probability, so the draw is the same in every run and repeated rows share their
    fate; the kept tokens match the targets in expectation, as far as cells have enough. Documents
    without tokens are kept only if others of their cell can be, by the same probability.
    """
    dimensions = list(targets)
    described = _described(docs, id_column, text_column, {d: d for d in dimensions}, seed)
    narrow = durable(described.select(F.col(id_column).alias("doc_id"), "_u", *(f"_d_{d}" for d in dimensions), n_words(F.col(text_column)).alias("n_tokens")))
    rated = durable(rates(rake(_cells(narrow, dimensions), targets), keep))
    out = _with_rates(narrow, rated, dimensions)
    return out.select("doc_id", *(F.col(f"_d_{d}").alias(d) for d in dimensions), "n_tokens", "weight", "probability", (F.col("_u") < F.col("probability")).alias("kept"))


def _cells(narrow: DataFrame, dimensions: list[str]) -> DataFrame:
    return durable(narrow.groupBy(*(F.col(f"_d_{d}").alias(d) for d in dimensions)).agg(F.sum("n_tokens").alias("tokens")))


def sample(docs: DataFrame, targets: Targets, keep: float, id_column: str = "doc_id", text_column: str = "text", seed: int = 3) -> DataFrame:
    """The rows of ``docs`` that ``mixed`` keeps, with all their columns, whatever their names."""
    dimensions = list(targets)
    at = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    described = _described(docs.toDF(*at.values()), at[id_column], at[text_column], {d: at.get(d, d) for d in dimensions}, seed)
    narrow = described.select(*(f"_d_{d}" for d in dimensions), n_words(F.col(at[text_column])).alias("n_tokens"))
    rated = durable(rates(rake(_cells(narrow, dimensions), targets), keep))
    return _with_rates(described, rated, dimensions).where("_u < probability").select(*(F.col(k).alias(c) for c, k in at.items()))
