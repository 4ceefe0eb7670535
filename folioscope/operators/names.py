"""Matching of known names in text: substring join, best match, greedy longest match."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import arrow
from folioscope.functions.text import QUERY_EDGES, WHITESPACE, fold_label, fold_plain, squeeze
from folioscope.session import durable

#: Characters of names that one sieve holds; more names take several passes over the texts. Bits of a sieve, a power of two: the least and the most (32 MB), and as many a name as fit.
SLICE_CHARS = 1 << 27
SIEVE_BITS, BITS_EACH = (1 << 16, 1 << 28), 32
#: Bytes of texts that are hashed at once, and of texts whose hits are told apart at once.
BLOCK, PORTION = 1 << 17, 1 << 20
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_SHIFT = np.uint64(32)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _SHIFT)) * _M[3]
    return h ^ (h >> _SHIFT)


def _windows(data: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(q, hashes of the q bytes from each place on) for q = 1, 2, 4 and on while q <= ``longest``, each made of the last."""
    q, h = 1, _mixed(data.astype(np.uint64) + np.uint64(1))
    while q <= longest:
        yield q, h
        h, q = _mixed(h[: max(len(h) - q, 0)] * _M[0] + h[q:] * _M[1]), 2 * q


def _name_hash(first: np.ndarray, last: np.ndarray, n) -> np.ndarray:
    """Hash of n bytes from those of the first and the last window, which cover them all."""
    return _mixed(first * _M[1] + last * _M[2] + np.atleast_1d(np.asarray(n, np.uint64)) * _M[0])


def _marks(h: np.ndarray, k: int, bits: int) -> Iterator[np.ndarray]:
    """k places in a table of so many bits for each hash."""
    for i in range(k):
        yield ((h >> np.uint64(16 * i)) ^ (h << np.uint64(9 * i))) & np.uint64(bits - 1) if i else h & np.uint64(bits - 1)


def _utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and where each row begins, with the end of the last; nulls are empty."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.fill_null(arrow.texts([""])[0]).cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def _prefix_hash(first: np.ndarray, last: np.ndarray, n) -> np.ndarray:
    """Hash of the first n bytes of a longer name, told apart from that of a name of n bytes."""
    return _name_hash(first, last, n) ^ _M[1]


def _lowest(least: int) -> int:
    """The greatest power of two up to the length of the shortest name."""
    return 1 << (least.bit_length() - 1)


class Sieve:
    """A table of bits with marks of names, which holds back almost all text that is none of them.

    A name of n bytes is known by the hashes of its first and of its last q bytes, q the greatest power of two up to n. Marked are also
    its first bytes by every power of two up to q, and from there on by the steps of a binary search for n. So a place
    in a text is left as soon as no name begins like it, and few lengths are tried, whatever number of names and lengths there is.
    """

    def __init__(self, table: np.ndarray, lengths: list[int]):
        self.table, self.lengths = table, lengths

    def _hit(self, h: np.ndarray, k: int) -> np.ndarray:
        """Indexes of the hashes all of whose marks are set."""
        kept = None
        for i, place in enumerate(_marks(h, k, 64 * len(self.table))):
            place = place if kept is None else place[kept]
            hit = np.flatnonzero((self.table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1))
            kept = hit if kept is None else kept[hit]
        return kept

    def found(self, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, first byte, number of bytes) of what may be a name, for rows that begin ``at`` these bytes of ``data``."""
        if not self.lengths:
            return
        longest, lowest = self.lengths[-1], _lowest(self.lengths[0])
        for begin in range(0, len(data), BLOCK):
            part = data[begin : begin + BLOCK + longest]
            start = row = room = None  # places at which a name of q bytes or more may begin, their rows and what these have left
            for q, h in _windows(part, min(longest, len(part))):
                if q < lowest:
                    continue
                if start is None:
                    start = self._hit(h[:BLOCK] ^ np.uint64(q), 2)
                    start = start[(part[start] & 0xC0) != 0x80]
                    row = np.searchsorted(at, begin + start, "right") - 1
                    room = at[row + 1] - begin - start
                    kept = np.flatnonzero(room >= q)
                else:
                    kept = np.flatnonzero(room >= q)
                    kept = kept[self._hit(h[start[kept]] ^ np.uint64(q), 2)]
                start, row, room = start[kept], row[kept], room[kept]
                if not len(start):
                    break
                most = max((n for n in self.lengths if q <= n < 2 * q), default=0)
                if most:
                    which, n = self._lengths(h, start, room, q, most)
                    p = start[which]
                    whole = (room[which] == n) | ((part[np.minimum(p + n, len(part) - 1)] & 0xC0) != 0x80)
                    if whole.any():
                        yield row[which[whole]], begin + p[whole], n[whole]

    def _lengths(self, h: np.ndarray, start: np.ndarray, room: np.ndarray, q: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``start``, number of bytes) of what may be a name of q to ``most`` bytes, less than 2q. h: hashes of q bytes."""
        which, n, step = np.arange(len(start)), np.full(len(start), q), q // 2
        while step:
            longer = np.flatnonzero((n + step <= most) & (n + step <= room[which]))
            i, m = which[longer], n[longer] + step
            hit = self._hit(_prefix_hash(h[start[i]], h[start[i] + m - q], m), 2)
            which, n, step = np.concatenate([which, i[hit]]), np.concatenate([n, m[hit]]), step // 2
        hit = self._hit(_name_hash(h[start[which]], h[start[which] + n - q], n), 3)
        return which[hit], n[hit]


def _places(data: np.ndarray, at: np.ndarray, least: int, bits: int) -> np.ndarray:
    """Places in a table of so many bits that the names which begin ``at`` these bytes mark; none is shorter than ``least``."""
    size = np.diff(at)
    places = [np.zeros(0, np.uint64)]
    for q, h in _windows(data, int(size.max(initial=0))):
        if q < _lowest(least):
            continue
        there = np.flatnonzero(size >= q)
        places += _marks(np.unique(h[at[there]]) ^ np.uint64(q), 2, bits)
        own = np.flatnonzero((size >= q) & (size < 2 * q))
        begin, n = at[own], size[own]
        reached, step = np.full(len(own), q), q // 2
        while step:
            longer = np.flatnonzero(reached + step <= n)
            reached[longer] += step
            m = reached[longer]
            places += _marks(np.unique(_prefix_hash(h[begin[longer]], h[begin[longer] + m - q], m)), 2, bits)
            step //= 2
        places += _marks(_name_hash(h[begin], h[begin + n - q], n), 3, bits)
    return np.unique(np.concatenate(places))


def sieve_of(strings: DataFrame) -> Sieve:
    """The sieve of a column ``needle``. Its marks are added up in Spark; the driver sees words of bits, not names."""
    lengths = strings.groupBy(F.octet_length("needle").alias("n")).count().collect()
    count, least = sum(r["count"] for r in lengths), min((r["n"] for r in lengths), default=1)
    bits = min(max(1 << (BITS_EACH * count - 1).bit_length(), SIEVE_BITS[0]), SIEVE_BITS[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = _utf8(batch.column(0))
            places = _places(data, at, least, bits)
            word, begins = np.unique(places >> np.uint64(6), return_index=True)
            if len(word):
                ones = np.bitwise_or.reduceat(np.uint64(1) << (places & np.uint64(63)), begins)
                yield pa.RecordBatch.from_arrays([arrow.numbers(word.astype(np.int32)), arrow.numbers(ones.view(np.int64))], ["word", "ones"])

    rows = strings.select("needle").mapInArrow(run, "word int, ones bigint").groupBy("word").agg(F.bit_or("ones").alias("ones")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[rows["word"].to_numpy()] = rows["ones"].to_numpy().view(np.uint64)
    return Sieve(table, sorted(r["n"] for r in lengths))


def alias_table(registry: DataFrame, fold=fold_label) -> DataFrame:
    """One row per (entity, distinct spelling) with its folded form; blank spellings vanish."""
    spellings = F.array_union(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return (
        registry.select("canonical_name", F.explode(spellings).alias("alias"))
        .withColumn("alias_norm", fold("alias"))
        .filter(F.col("alias_norm") != "")
    )


def sliced(needles: DataFrame, needle: str) -> tuple[DataFrame, int]:
    """Distinct non-empty needles with their ``slice``, stored, and the number of slices, each within SLICE_CHARS if no needle is longer."""
    own = needles.select(F.col(needle).alias("needle")).where("needle <> ''").distinct()
    own = durable(own.select("needle", F.xxhash64("needle").alias("h"), F.length("needle").alias("n")))
    total = own.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    slices = -(-(total["n"] or 0) // SLICE_CHARS)
    while slices:
        sums = own.groupBy(F.pmod("h", F.lit(slices)).alias("slice")).agg(F.sum("n").alias("n"), F.count("*").alias("needles"))
        if sums.where(f"n > {SLICE_CHARS} and needles > 1").isEmpty():
            break
        slices *= 2
    return own.select("needle", F.pmod("h", F.lit(max(slices, 1))).alias("slice")), slices


def occurrences(
    texts: DataFrame, keys: Sequence[str], haystack: str, needles: DataFrame, needle: str,
    fold: Callable[[Column | str], Column] | None = None, places: bool = False,
) -> DataFrame:
    """(keys, needle), once for each text and needle inside it; with ``places`` every occurrence and its ``start`` from 1.

    With ``fold`` the haystack column is raw text and is folded here. Needles are cut to slices of bounded size; for each
    slice a sieve of all its needles, a table of bits of bounded size, is told to the tasks, which hash every text once and cut out what may
    be a needle; a semi-join with the needles decides. With several slices the folded texts are stored once and so are the
    hits of each. Null texts have no hits, empty needles are left out, repeated texts and keys are kept apart as rows.
    """
    keys = list(keys)
    prepared = texts.select(*keys, (fold(haystack) if fold else F.col(haystack)).alias("_text"))
    kinds = ", ".join(f"`{k}` {prepared.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, `{needle}` string" + (", start int" if places else "")
    strings, slices = sliced(needles, needle)
    if slices > 1 and fold:
        prepared = durable(prepared)
    parts = [_found(prepared, schema, needle, strings.where(F.col("slice") == k).select("needle"), places) for k in range(slices)]
    if not parts:
        return texts.sparkSession.createDataFrame([], schema)
    return parts[0] if slices == 1 else reduce(DataFrame.unionByName, [durable(p) for p in parts])


def _cut_out(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The texts of so many bytes from these places on."""
    ends = np.cumsum(size)
    taken = data[np.repeat(start - (ends - size), size) + np.arange(ends[-1])]
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(taken))


def _found(prepared: DataFrame, schema: str, needle: str, strings: DataFrame, places: bool) -> DataFrame:
    told = prepared.sparkSession.sparkContext.broadcast(sieve_of(strings))
    texts = len(prepared.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = told.value
        for batch in batches:
            every, at = _utf8(batch.column(texts))
            row = 0
            while row < batch.num_rows:
                stop = max(int(np.searchsorted(at, at[row] + PORTION, "right")) - 1, row + 1)
                data, own = every[at[row] : at[stop]], at[row : stop + 1] - at[row]
                hits = [np.concatenate(h) for h in zip(*sieve.found(data, own), strict=True)]
                if hits:
                    rows, start, size = hits
                    columns = {"row": arrow.numbers(rows), "needle": _cut_out(data, start, size).cast(pa.string())}
                    if places:
                        before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                        columns["start"] = arrow.numbers((before[start] - before[own[rows]] + 1).astype(np.int32))
                    found = pa.table(columns)
                    found = found if places else found.group_by(["row", "needle"]).aggregate([])
                    keys = batch.slice(row).take(found["row"].combine_chunks())
                    rest = [found[c].combine_chunks() for c in columns if c != "row"]
                    yield pa.RecordBatch.from_arrays([*keys.columns[:texts], *rest], [*batch.schema.names[:texts], needle, *(["start"] if places else [])])
                row = stop

    wanted = strings.select(F.col("needle").alias(needle))
    return prepared.mapInArrow(run, schema).join(wanted, needle, "left_semi").select(*prepared.columns[:texts], needle, *(["start"] if places else []))


def find_substrings(
    texts: DataFrame, keys: Sequence[str], haystack: str, needles: DataFrame, needle: str,
    fold: Callable[[Column | str], Column] | None = None,
) -> DataFrame:
    """Distinct (key, needle) pairs where the needle occurs anywhere inside the haystack; see ``occurrences``."""
    return occurrences(texts, keys, haystack, needles, needle, fold).distinct()


def best_match(pairs: DataFrame, keys: Sequence[str], aliases: DataFrame) -> DataFrame:
    """Entity of the longest matched spelling per key; ties go to the greater name."""
    return (
        pairs.join(aliases.select("alias_norm", "canonical_name").distinct(), "alias_norm")
        .groupBy(*keys)
        .agg(F.max(F.struct(F.length("alias_norm").alias("len"), F.col("canonical_name").alias("fund"))).alias("_m"))
        .select(*keys, "_m.fund")
    )


def exact_owner(aliases: DataFrame) -> DataFrame:
    """Folded spelling to its owner (all exact matches have one length, so the greatest name)."""
    return aliases.groupBy("alias_norm").agg(F.max("canonical_name").alias("fund"))


def mentions(texts: DataFrame, keys: Sequence[str], text: str, registry: DataFrame, fold=None) -> DataFrame:
    """Distinct (key, canonical_name) for entities with any spelling inside the text."""
    aliases = durable(alias_table(registry))
    pairs = find_substrings(texts, keys, text, aliases, "alias_norm", fold)
    return (
        pairs.join(aliases.select("alias_norm", "canonical_name").distinct(), "alias_norm")
        .select(*keys, "canonical_name")
        .distinct()
    )


def greedy_longest(matches: Column) -> Column:
    """Non-overlapping matches, longest first, earlier first among equals, then in registry order (by folded name).

    ``matches`` holds structs with ``start``, ``stop``, ``place`` (of the name in the registry) and ``fund``. A match blocked only by a
    match that was itself rejected is kept, hence the fold.
    """
    ordered = F.array_sort(
        F.transform(
            matches,
            lambda m: F.struct(
                (m["start"] - m["stop"]).alias("neg_len"), m["start"].alias("start"),
                m["stop"].alias("stop"), m["place"].alias("place"), m["fund"].alias("fund"),
            ),
        )
    )
    none = F.filter(ordered, lambda m: F.lit(False))
    return F.aggregate(
        ordered,
        none,
        lambda kept, m: F.when(
            F.exists(kept, lambda k: (m["stop"] > k["start"]) & (m["start"] < k["stop"])), kept
        ).otherwise(F.array_append(kept, m)),
    )


def detect_entities(queries: DataFrame, registry: DataFrame, query: str = "query") -> DataFrame:
    """Add ``query_funds``: entities named in each query, in order of first mention."""
    aliases = alias_table(registry, fold_plain)
    folded = queries.select("query_id", fold_plain(query).alias("_folded"))
    places = occurrences(folded, ["query_id"], "_folded", aliases, "alias_norm", places=True)
    stop = F.col("start") + F.length("alias_norm")
    found = (
        places.join(aliases.select("alias_norm", "canonical_name", fold_label("canonical_name").alias("place")).distinct(), "alias_norm")
        .groupBy("query_id")
        .agg(F.collect_list(F.struct("start", stop.alias("stop"), "place", F.col("canonical_name").alias("fund"))).alias("_matches"))
    )
    in_order = F.array_sort(
        F.transform(greedy_longest(F.col("_matches")), lambda m: F.struct(m["start"], m["fund"].alias("fund")))
    )
    funds = F.array_distinct(F.transform(in_order, lambda m: m["fund"]))
    return queries.join(found.select("query_id", funds.alias("_f")), "query_id", "left").withColumn(
        "query_funds", F.coalesce("_f", F.array().cast("array<string>"))
    ).drop("_f")


def strip_entities(queries: DataFrame, registry: DataFrame, query: str = "query", name: str = "search_query") -> DataFrame:
    """Add the query without any spelling of its own entities (longest spelling first).

    Falls back to the full query when nothing would remain.
    """
    spellings = F.array_union(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    by_name = registry.select(
        F.col("canonical_name").alias("_fund"), F.explode(spellings).alias("_alias")
    ).filter(squeeze("_alias") != "")
    wanted = (
        queries.select("query_id", F.explode("query_funds").alias("_fund"))
        .join(by_name, "_fund")
        .groupBy("query_id")
        .agg(F.collect_set(F.struct((-F.length("_alias")).alias("n"), F.col("_alias").alias("a"))).alias("_s"))
        .select("query_id", F.transform(F.array_sort("_s"), lambda s: s["a"]).alias("_aliases"))
    )
    literal = lambda a: F.concat(F.lit("(?iu)\\Q"), F.replace(a, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    removed = F.aggregate("_aliases", F.col(query), lambda text, a: F.regexp_replace(text, literal(a), F.lit(" ")))
    cleaned = F.btrim(F.regexp_replace(removed, WHITESPACE, " "), F.lit(QUERY_EDGES))
    return (
        queries.join(wanted, "query_id", "left")
        .withColumn(
            name,
            F.when(F.col("_aliases").isNull() | (cleaned == ""), F.col(query)).otherwise(cleaned),
        )
        .drop("_aliases")
    )


def routed(fund: Column, query_funds: Column) -> Column:
    """Whether a chunk is in the query's pool: its entities, or entity-free without any."""
    return F.when(F.size(query_funds) == 0, fund.isNull()).otherwise(
        F.coalesce(F.array_contains(query_funds, fund), F.lit(False))
    )
