"""Near-duplicate vectors by sorted projection passes.

In each pass every distinct vector gets the signs of random projections, from the mean of all, as one
number, all are sorted by it, and each is compared with a bounded window of its neighbours in that order.
Each pass also measures how crowded the order is around a vector, hence how likely a partner was met.
Passes go on over the vectors for which that isn't likely enough yet; where passes would move more rows
than comparing these vectors with each other in tiles, they are compared in tiles. Verified pairs are
united to components; inside a component every vector is then compared with every other, in tiles, so
that link counts don't depend on window or passes.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.components import components, smallest_reached
from folioscope.session import discard, durable

BITS = 48
WINDOW = 32
#: Rows of a tile's side when a component is compared with itself.
TILE = 256
#: Groups that small components share at least; beyond, one for each TILE linked vectors.
SHARED = 997
#: Rows of a tile's side when vectors that passes can't settle are compared with each other.
REST_TILE = 1024
#: Passes sorted at a time after the first ones.
ROUND = 32


def passes_for(vectors: int, cosine: float, window: int, recall: float) -> int:
    """Passes after which a lone pair at the threshold has met in a window with probability ``recall`` if directions spread evenly.

    A window holds the vectors that share about log2(vectors / window) leading signs; two vectors
    share one sign with probability 1 - angle / pi.
    """
    signs = max(0.0, math.log2(max(vectors, 1) / window))
    meet = (1 - math.acos(cosine) / math.pi) ** signs
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(meet, 0.999))))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.array(column.flatten(), dtype=np.float64).reshape(-1, size)


def checked(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v, size, digest): ``v`` and ``digest`` are null where a vector can't link with anything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, digests, sizes = [], [], []
            for vector in batch.column(1).to_pylist():
                whole = vector is not None and len(vector) > 0 and None not in vector
                a = np.array(vector, np.float64) if whole else None
                if whole and np.isfinite(a).all() and a.any():
                    digests.append(hashlib.blake2b((a + 0.0).tobytes(), digest_size=16).digest())
                    rows.append(vector)
                    sizes.append(len(vector))
                else:
                    digests.append(None)
                    rows.append(None)
                    sizes.append(None)
            kind = batch.column(1).type
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary())], ["vec_id", "v", "size", "digest"])

    given = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("v"))
    return given.mapInArrow(run, f"vec_id long, v {given.schema['v'].dataType.simpleString()}, size int, digest binary")


def _means(distinct: DataFrame) -> dict[int, np.ndarray]:
    """Mean of the unit vectors of each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = np.asarray(batch.column(0))
            for size in np.unique(sizes).tolist():
                x = _matrix(batch.column(1).take(pa.array(np.flatnonzero(sizes == size))), size)
                totals[size] = totals.get(size, 0) + np.append((x / np.linalg.norm(x, axis=1, keepdims=True)).sum(axis=0), len(x))
        rows = [(size, k, v) for size, total in totals.items() for k, v in enumerate(total.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int32(), pa.int32(), pa.float64()))], ["size", "place", "v"])

    sums = distinct.select("size", "v").mapInArrow(run, "size int, place int, v double").groupBy("size", "place").agg(F.sum("v").alias("v"))
    totals: dict[int, np.ndarray] = {}
    for r in sums.collect():
        totals.setdefault(r["size"], np.zeros(r["size"] + 1))[r["place"]] = r["v"]
    return {size: np.round(total[:-1] / total[-1], 6) for size, total in totals.items()}  # rounded: sums depend on the order of tasks


def _keyed(distinct: DataFrame, passes: int, seed: list[int], means: dict[int, np.ndarray], cosine: float) -> DataFrame:
    """Add ``keys``, per pass the signs of the projections of the vector from the mean, and ``agree``.

    ``agree`` is the least probability that a vector linked with this one has the same sign: from the mean,
    at distance r, a vector at most d away is seen at an angle of at most asin(d / r).
    """
    told = distinct.sparkSession.sparkContext.broadcast(means)
    apart = math.sqrt(max(0.0, 2 - 2 * cosine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        places = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            sizes = np.asarray(batch.column(2))
            keys = np.zeros((batch.num_rows, passes), np.int64)
            agree = np.zeros(batch.num_rows)
            for size in np.unique(sizes).tolist():
                if size not in planes:
                    planes[size] = np.random.default_rng([*seed, size]).standard_normal((size, passes * BITS))
                own = np.flatnonzero(sizes == size)
                x = _matrix(batch.column(1).take(pa.array(own)), size)
                x = x / np.linalg.norm(x, axis=1, keepdims=True) - told.value[size]
                r = np.linalg.norm(x, axis=1)
                agree[own] = np.where(r > apart, 1 - np.arcsin(apart / np.maximum(r, apart)) / np.pi, 0.0) if apart else 1.0
                keys[own] = (x @ planes[size] > 0).reshape(len(own), passes, BITS) @ places
            lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), passes).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(agree), lists], ["node", "v", "size", "agree", "keys"])

    kind = distinct.schema["v"].dataType.simpleString()
    return distinct.select("node", "v", "size").mapInArrow(run, f"node long, v {kind}, size int, agree double, keys array<long>")


def signs_needed(keys: np.ndarray, window: int, begins: bool, ends: bool) -> np.ndarray:
    """How many leading signs another row must share with each row of a stretch of sorted keys to be in its window for certain.

    That is where no more than ``window`` others share them; BITS + 1 if more share all. Unless the stretch begins
    (ends) with the first (last) key of all, rows beyond it may share whatever its first (last) key does.
    """

    def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return BITS - np.frexp((a ^ b).astype(np.float64))[1]

    need = np.zeros(len(keys), np.int64)
    if len(keys) > window + 1:
        crowd = shared(keys[: -window - 1], keys[window + 1 :]) + 1
        wide = np.concatenate([np.zeros(window + 1, np.int64), crowd, np.zeros(window + 1, np.int64)])
        need = np.lib.stride_tricks.sliding_window_view(wide, window + 2).max(axis=1)
    if not begins:
        need = np.maximum(need, shared(keys, keys[:1]) + 1)
    if not ends:
        need = np.maximum(need, shared(keys, keys[-1:]) + 1)
    return need


def _window_links(ordered: DataFrame, cosine: float, window: int) -> DataFrame:
    """(a, b, met): links that join what the verified pairs of each stretch of the sorted rows join, and for each row
    and pass, with b null, -log of the probability that the pass missed a partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict = {}
        for batch in batches:
            which, size = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            keys, agree = np.asarray(batch.column(4)), np.asarray(batch.column(5))
            cuts = [0, *(np.flatnonzero((which[1:] != which[:-1]) | (size[1:] != size[:-1])) + 1).tolist(), batch.num_rows]
            left, right, met = [], [], []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                rows = batch.column(3).slice(a, b - a)
                x = _matrix(rows, int(size[a]))
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                nodes = np.asarray(batch.column(2).slice(a, b - a))
                # Rows of other batches and tasks aren't looked at for this, which can only understate it.
                need = signs_needed(keys[a:b], window, a > 0, b < batch.num_rows)
                met.append(np.where(need <= BITS, -np.log1p(-np.minimum(agree[a:b] ** need, 1 - 1e-12)), 0.0))
                if last.get("key") == (which[a], size[a]):
                    x, nodes = np.concatenate([last["x"], x]), np.concatenate([last["nodes"], nodes])
                u, v = [], []
                for k in range(1, min(window, len(x) - 1) + 1):
                    hit = np.flatnonzero(np.einsum("ij,ij->i", x[:-k], x[k:]) >= cosine)
                    u.append(hit)
                    v.append(hit + k)
                if u:
                    root = smallest_reached(len(x), np.concatenate(u), np.concatenate(v))
                    moved = np.flatnonzero(root != np.arange(len(x)))
                    left.append(nodes[moved])
                    right.append(nodes[root[moved]])
                last = {"key": (which[b - 1], size[b - 1]), "x": x[-window:], "nodes": nodes[-window:]}
            if left:
                one, two = np.concatenate(left), np.concatenate(right)
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.nulls(len(one), pa.float64())], ["a", "b", "met"])
            if met:
                yield pa.RecordBatch.from_arrays([batch.column(2), pa.nulls(batch.num_rows, pa.int64()), pa.array(np.concatenate(met))], ["a", "b", "met"])

    return ordered.select("pass", "size", "node", "v", "key", "agree").mapInArrow(run, "a long, b long, met double")


def _rest_links(rest: DataFrame, cosine: float) -> DataFrame:
    """Links (a, b) that join what is linked among ``rest`` (node, v, size), every vector compared with every other in tiles."""
    blocks = F.ceil(F.col("of") / REST_TILE)
    dealt = rest.join(rest.groupBy("size").agg(F.count("*").alias("of")), "size").withColumn("block", F.pmod(F.xxhash64("node"), blocks))
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: F.struct(F.least(j, "block").alias("i"), F.greatest(j, "block").alias("j")))
    each = dealt.select("size", "block", "node", "v", F.explode(tiles).alias("t")).select("size", "t.i", "t.j", "block", "node", "v")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        block, node = np.asarray(table["block"]), np.asarray(table["node"])
        x = _matrix(table["v"].chunk(0), table["size"][0].as_py())
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        one, two = np.flatnonzero(block == table["i"][0].as_py()), np.flatnonzero(block == table["j"][0].as_py())
        u, v = np.nonzero(x[one] @ x[two].T >= cosine)
        root = smallest_reached(len(x), one[u], two[v])
        moved = np.flatnonzero(root != np.arange(len(x)))
        return pa.table({"a": node[moved], "b": node[root[moved]]})

    return each.groupBy("size", "i", "j").applyInArrow(run, "a long, b long")


def _links(distinct: DataFrame, cosine: float, window: int, first: int, recall: float, seed: int) -> list[DataFrame]:
    """Tables of links (a, b) that join each vector with its partners, any of which is found with probability ``recall``."""
    spark, goal, means = distinct.sparkSession, -math.log(1 - recall), _means(distinct)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found: list[DataFrame] = []
    rest, passes, done = durable(distinct.select("node", "v", "size", F.lit(0.0).alias("met"))), first, 0
    while True:
        # The first pass of a round has its own planes, so that no two rounds sort alike.
        keyed = _keyed(rest, passes, [seed, done] if done else [seed], means, cosine).select("node", "v", "size", "agree", F.posexplode("keys").alias("pass", "key"))
        ordered = keyed.repartitionByRange(parts, "pass", "size", "key", "node").sortWithinPartitions("pass", "size", "key", "node")
        out = durable(_window_links(ordered, cosine, window))
        found.append(out)
        gained = out.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("met").alias("gain"))
        # A pair is missed only if it may be missed from both sides, so vectors that are done needn't meet the rest again.
        left = rest.drop("gain").join(gained, "node").select("node", "v", "size", (F.col("met") + F.col("gain")).alias("met"), "gain").where(F.col("met") < goal)
        left = durable(left)
        discard(rest)
        rest, done = left, done + passes
        count, gain, missing = rest.agg(F.count("*"), F.avg("gain"), F.avg(F.lit(goal) - F.col("met"))).first()
        if not count:
            break
        needed = math.ceil(1.25 * missing * passes / gain) if gain else math.inf
        if needed >= math.ceil(count / REST_TILE):
            found.append(durable(_rest_links(rest.select("node", "v", "size"), cosine)))
            break
        passes = min(needed, ROUND)
    discard(rest)
    return found


def _tile_counts(members: DataFrame, cosine: float, shared: int) -> DataFrame:
    """(node, links): rows linked with each node, from all tiles of its component. Needs component, node, v, size, w.

    Small components are dealt to ``shared`` groups.
    """
    sizes = members.groupBy("component", "size").agg(F.count("*").alias("of"))
    blocks = F.ceil(F.col("of") / TILE)
    dealt = members.join(sizes, ["component", "size"]).withColumn("block", F.pmod(F.xxhash64("node"), blocks))
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: F.struct(F.least(j, "block").alias("i"), F.greatest(j, "block").alias("j")))
    each = dealt.withColumn("tile", F.explode(tiles))
    # Small components share groups, as a group for each would be too many.
    group = F.when(F.col("of") <= TILE, F.pmod(F.xxhash64("component"), F.lit(shared))).otherwise(F.xxhash64("component", "tile"))
    each = each.select(group.alias("group"), "component", "size", "block", F.col("tile.i").alias("i"), F.col("tile.j").alias("j"), "node", "v", "w")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        order = table.sort_by([(c, "ascending") for c in ("component", "size", "i", "j")])
        key = np.stack([np.asarray(order[c]) for c in ("component", "size", "i", "j")])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), order.num_rows]
        nodes, links = [], []
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = order.slice(a, b - a).combine_chunks()
            x = _matrix(own["v"].combine_chunks() if isinstance(own["v"], pa.ChunkedArray) else own["v"], int(key[1, a]))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            w, block, node = np.asarray(own["w"]), np.asarray(own["block"]), np.asarray(own["node"])
            one, two = np.flatnonzero(block == key[2, a]), np.flatnonzero(block == key[3, a])
            near = x[one] @ x[two].T >= cosine
            nodes.append(node[one])
            links.append(near @ w[two])
            if key[2, a] != key[3, a]:
                nodes.append(node[two])
                links.append(near.T @ w[one])
            else:
                links[-1] -= np.where(np.diagonal(near), w[one], 0)  # a vector and itself
        return pa.table({"node": np.concatenate(nodes), "links": np.concatenate(links).astype(np.int64)})

    return each.groupBy("group").applyInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", cosine: float = 0.95, window: int = WINDOW,
    passes: int | None = None, recall: float = 0.99, seed: int = 7,
) -> DataFrame:
    """One row per vector: (vec_id, n_links, component_id, kept).

    Cosines are computed in double precision. Null, empty and zero vectors, those with null or
    non-finite components and rows without an id link with nothing; vectors of different lengths don't
    link. Equal vectors are one row of the search and count with their number. An id that comes twice
    is one node. ``passes`` are those before anything is measured and follow from the number of distinct
    vectors when they aren't given. Then the crowding found around each vector decides how many more it
    takes, so that a pair on its own is found with probability ``recall`` however directions spread; in a
    group of more, any chain of met pairs will do. Link counts are exact inside the components found.
    """
    given = durable(checked(vectors, id_column, vector_column))
    usable = given.where("digest is not null and vec_id is not null")
    distinct = durable(usable.groupBy("digest", "size").agg(F.min("vec_id").alias("node"), F.count("*").alias("w"), F.first("v").alias("v")))
    n = passes or passes_for(distinct.count(), cosine, window, recall)
    found = _links(distinct, cosine, window, n, recall, seed)
    links = functools.reduce(DataFrame.union, (f.where("b is not null").select("a", "b") for f in found))
    labels = durable(components(links))
    discard(*found)
    members = distinct.join(labels, "node")
    counts = _tile_counts(members, cosine, max(SHARED, math.ceil(labels.count() / TILE)))
    per_vector = (
        distinct.select("digest", "node", "w")
        .join(labels, "node", "left")
        .join(counts, "node", "left")
        .select("digest", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    )
    per_vector = durable(per_vector)
    linked = usable.select("vec_id", "digest").join(per_vector, "digest").select("vec_id", "n_links", "component_id")
    alone = given.where("digest is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    discard(labels, distinct)
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
