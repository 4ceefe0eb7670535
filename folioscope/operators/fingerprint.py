"""Content fingerprints used to decide whether stored vectors are still valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET = 1024
LEAVES = 256


def row_bytes(*values: str) -> Column:
    """Values as text, each closed by a NUL byte; a missing value reads ``None``."""
    return F.concat(*[x for v in values for x in (F.coalesce(F.col(v).cast("string"), F.lit("None")), F.lit("\0"))])


def chunk_fingerprint(chunks: DataFrame) -> DataFrame:
    """One-row tree digest over id, section and text in chunk order.

    Rows hash in place, runs of ``BUCKET`` hash together, and only one digest per run reaches
    the final step.
    """
    order = F.struct("chunk_ord", "h")
    rows = chunks.select("chunk_ord", F.sha2(row_bytes("chunk_id", "section", "text"), 256).alias("h"))
    joined = lambda: F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda s: s["h"]), "")
    level = rows
    for _ in range(3):  # 1024^4 rows fit in one last bucket
        level = level.groupBy(F.floor(F.col("chunk_ord") / BUCKET).alias("chunk_ord")).agg(
            F.sha2(joined(), 256).alias("h")
        )
    return level.groupBy().agg(F.sha2(joined(), 256).alias("chunk_fingerprint"))


def digest_leaves(chunks: DataFrame) -> DataFrame:
    """``place, chunk_id, digest``: where a chunk stands in the digest tree, by its id, and the digest of its section and text."""
    return chunks.select(F.xxhash64("chunk_id").alias("place"), "chunk_id", F.sha2(row_bytes("chunk_id", "section", "text"), 256).alias("digest"))


def tree_depth(rows: int) -> int:
    """Levels of a tree of fanout 16 whose lowest nodes have about LEAVES rows or fewer."""
    depth = 1
    while rows > LEAVES << 4 * depth:
        depth += 1
    return depth


def digest_nodes(leaves: DataFrame, depth: int) -> DataFrame:
    """``depth, prefix, digest`` of all inner nodes; a node covers the places that share its leading ``4 * depth`` bits."""
    prefix = lambda d: F.shiftrightunsigned("place", 64 - 4 * d)
    order = F.array_sort(F.collect_list(F.struct("place", "chunk_id", "digest")))
    level = leaves.groupBy(prefix(depth).alias("prefix")).agg(F.sha2(F.array_join(F.transform(order, lambda s: s["digest"]), ""), 256).alias("digest"))
    out = level.select(F.lit(depth).alias("depth"), "prefix", "digest")
    for d in range(depth - 1, 0, -1):
        below = F.array_sort(F.collect_list(F.struct("prefix", "digest")))
        level = level.groupBy(F.shiftrightunsigned("prefix", 4).alias("prefix")).agg(F.sha2(F.array_join(F.transform(below, lambda s: s["digest"]), ""), 256).alias("digest"))
        out = out.unionByName(level.select(F.lit(d).alias("depth"), "prefix", "digest"))
    return out


def changed_chunks(saved_nodes: DataFrame, saved_leaves: DataFrame, nodes: DataFrame, leaves: DataFrame, depth: int) -> DataFrame:
    """``chunk_id`` of chunks that are new or differ from the saved ones.

    The trees, both at least ``depth`` deep, are compared level by level: only the children of nodes that differ are
    looked at, and only leaves under differing lowest nodes are joined.
    """
    differing: DataFrame | None = None
    for d in range(1, depth + 1):
        old, new = (t.where(F.col("depth") == d).select("prefix", F.col("digest").alias(name)) for t, name in ((saved_nodes, "old"), (nodes, "new")))
        if differing is not None:
            old, new = (t.withColumn("parent", F.shiftrightunsigned("prefix", 4)).join(differing, "parent", "left_semi").drop("parent") for t in (old, new))
        differing = old.join(new, "prefix", "full_outer").where("NOT (old <=> new)").select(F.col("prefix").alias("parent"))
    under = lambda t: t.withColumn("parent", F.shiftrightunsigned("place", 64 - 4 * depth)).join(differing, "parent", "left_semi").drop("parent")
    known = under(saved_leaves).select("place", "chunk_id", F.col("digest").alias("old"))
    return under(leaves).join(known, ["place", "chunk_id"], "left").where("NOT (digest <=> old)").select("chunk_id").distinct()


def index_metadata(chunks: DataFrame, model_name: str, passage_prefix: str, index_version: int) -> DataFrame:
    """The one-row validity record stored next to the vectors."""
    counted = chunks.agg(F.count("*").alias("chunk_count"))
    return chunk_fingerprint(chunks).select(
        F.lit(index_version).alias("index_version"), F.lit(model_name).alias("model_name"),
        F.lit(passage_prefix).alias("passage_prefix"),
        counted.scalar().alias("chunk_count"), "chunk_fingerprint",
    )


def metadata_differences(saved: DataFrame, current: DataFrame) -> DataFrame:
    """``key, saved, current`` for every field that differs."""

    def melted(df: DataFrame, value: str) -> DataFrame:
        pairs = [F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias(value)) for c in df.columns]
        return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")

    both = melted(saved, "saved").join(melted(current, "current"), "key", "full_outer")
    return both.filter(~F.col("saved").eqNullSafe(F.col("current")))
