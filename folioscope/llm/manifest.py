"""Merkle manifest of a dataset: a digest of every row, one root, and a proof for each row.

Rows are leaves, ordered inside their group; groups' trees meet in one more tree. A level of a tree is
one aggregate: a slot pivot spreads the children of each parent into as many columns as the fanout, the
concatenation of these columns gives the parent's digest, and leaving out a child's own column gives its siblings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import durable

FANOUT = 8


def field(value: Column) -> Column:
    """A value as part of a leaf: ``-`` for null, else its UTF-8 byte count, ``:`` and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts in a row."""
    return F.sha2(F.concat(*parts), 256)


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``pos``, their number from 0 in their ``grp`` by ``order``, and ``size``, the number of rows there.

    Rows are dealt by range of ``grp`` and ``order`` and numbered inside their partition. What is added up over a
    group is one count for each partition that has rows of it, and rows meet these counts by partition and group: no
    group, however large, is in one task. ``rows`` must be a stored table, since the ranges are sampled first.
    """
    numbered = rows.withColumn("_seed", F.monotonically_increasing_id())  # parts also rows that are equal in all of ``order``
    dealt = numbered.repartitionByRange("grp", *order, "_seed").sortWithinPartitions("grp", *order, "_seed").drop("_seed")
    stored = durable(dealt.withColumn("_at", F.monotonically_increasing_id()))
    stored = stored.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    parts = Window.partitionBy("grp").orderBy("_part")
    counts = stored.groupBy("_part", "grp").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("_part", "grp", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(Window.partitionBy("grp")).alias("size"))
    return stored.join(shifts, ["_part", "grp"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def _slots(fanout: int) -> list[str]:
    return [f"slot_{k}" for k in range(fanout)]


def _joined(slots: list[str]) -> str:
    """The digests of these slots in a row, as SQL; an empty slot adds nothing."""
    return "concat(''" + "".join(f", coalesce({s}.digest, '')" for s in slots) + ")"


def _level(nodes: DataFrame, fanout: int) -> DataFrame:
    """The parents of ``nodes`` (grp, pos, size, node): each child's ``node`` in its slot's column, and the parent as a node of its own."""
    names = _slots(fanout)
    spread = [F.expr(f"max(if(pos % {fanout} = {k}, node, null)) AS {name}") for k, name in enumerate(names)]
    wide = nodes.groupBy("grp", F.expr(f"pos div {fanout} AS pos")).agg(F.expr(f"max(size + {fanout - 1}) div {fanout} AS size"), *spread)
    return wide.selectExpr("*", f"named_struct('digest', sha2({_joined(names)}, 256)) AS node")


def _climb(nodes: DataFrame, most: int, fanout: int) -> list[DataFrame]:
    """The levels above ``nodes``, stored; ``most`` is the size of the largest group. A group ends where one node of it is left."""
    levels = []
    while most > 1:
        levels.append(durable(_level(nodes.where("size > 1"), fanout)))
        nodes, most = levels[-1], -(-most // fanout)
    return levels


def _descend(levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """Children of the lowest level with their ``path``: (left, right) siblings from their own level up, then what ``tops`` (grp, path, ...) have.

    A group's top stands at the level at which its size is 1.
    """
    names = _slots(fanout)
    kept = [c for c in tops.columns if c not in ("grp", "path")]
    children = ", ".join(
        f"named_struct('pos', pos * {fanout} + {k}, 'node', {name}, 'step', named_struct('left', {_joined(names[:k])}, 'right', {_joined(names[k + 1 :])}))"
        for k, name in enumerate(names)
    )
    below: DataFrame | None = None
    for level in reversed(levels):
        ends = level.where("size = 1").select("grp", "pos").join(tops, "grp")
        known = ends if below is None else ends.unionByName(below.drop("node"))
        below = (
            level.select("grp", "pos", *names)
            .join(known, ["grp", "pos"])
            .selectExpr("grp", *kept, "path", f"explode(array({children})) AS child")
            .where("child.node is not null")
            .selectExpr("grp", "child.pos AS pos", "child.node AS node", "concat(array(child.step), path) AS path", *kept)
        )
    return below


def manifest(
    docs: DataFrame, fields: list[str], group_column: str = "lang", order_column: str = "doc_id", tampered: dict[str, Column] | None = None, fanout: int = FANOUT,
) -> DataFrame:
    """One row per row of ``docs``: (order column, leaf, subroot, root, proof_sha256, folded_root, verified).

    ``leaf`` digests the ``fields`` in their order. Leaves of one group ascend by the order column (null
    first), then by leaf; every ``fanout`` consecutive nodes, the last run also fewer, become one until one is left, the
    subroot. The subroots by group (null first, bytewise) likewise give the root; a lone node is its own root.
    ``tampered`` gives columns with which the rows are checked against the manifest: ``folded_root`` is recomputed from
    them and the siblings, ``verified`` says whether it equals the root. Without it the rows as they are.

    Null fields are told from empty ones. Repeated rows are leaves of their own; equal ones are
    interchangeable. No rows give no rows. Other columns of ``docs``, whatever their names, aren't read.
    Groups of any size are spread over tasks: rows are numbered by range and a parent holds ``fanout`` children.
    """
    changed = tampered or {}
    group = F.coalesce(F.concat(F.lit("="), F.col(group_column).cast("string")), F.lit(""))
    rows = docs.select(
        F.col(order_column).alias("id"),
        group.alias("grp"),
        digest(*(field(F.col(f)) for f in fields)).alias("leaf"),
        digest(*(field(changed.get(f, F.col(f))) for f in fields)).alias("seen"),
    )
    base = placed(durable(rows), "id", "leaf").select("grp", "pos", "size", F.struct(F.col("leaf").alias("digest"), "seen", "id").alias("node"))
    most = base.agg(F.max("size")).first()[0] or 0
    levels = _climb(base, most, fanout)

    lone = base.where("size = 1")
    tops = reduce(DataFrame.unionByName, (x.where("size = 1").select("grp", F.col("node.digest").alias("subroot")) for x in (lone, *levels)))
    ranked = placed(durable(tops.select(F.lit("").alias("grp"), F.col("grp").alias("of"), "subroot")), "of")
    count = ranked.count()
    upper = ranked.select("grp", "pos", "size", F.struct(F.col("subroot").alias("digest"), "of").alias("node"))
    step = "array<struct<left string, right string>>"
    if count > 1:
        above = _climb(upper, count, fanout)
        root = above[-1].select("grp", F.array().cast(step).alias("path"), F.col("node.digest").alias("root"))
        told = _descend(above, root, fanout).select(F.col("node.of").alias("grp"), "path", F.col("node.digest").alias("subroot"), "root")
    else:
        told = ranked.select(F.col("of").alias("grp"), F.array().cast(step).alias("path"), "subroot", F.col("subroot").alias("root"))
    told = durable(told)

    alone = lone.join(told, "grp").select("node", "path", "subroot", "root")
    found = alone if not levels else alone.unionByName(_descend(levels, told, fanout).select("node", "path", "subroot", "root"))
    folded = F.aggregate("path", F.col("node.seen"), lambda own, s: digest(s["left"], own, s["right"]))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    out = found.select(
        F.col("node.id").alias(order_column), F.col("node.digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root")
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
