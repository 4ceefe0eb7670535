"""Runs of words that repeat with a period, and texts with the repetitions taken out.

A run is a stretch of at least 4 periods in which words one period apart are identical and that no
neighbouring word extends. Periods are taken by octaves [P, 2P). For each, a document is covered by overlapping
tiles, one around every P-th word; each tile is solved by itself: the two Z-functions at its boundary word, forward
and backward, say for every period of the octave how far words one period apart stay equal there, within the tile.
These interval fragments are shuffled by document and period and stitched. A run's stretch of equal words is at
least three periods long, so that some boundary lies in it with 2P + 1 equal words to follow: Z values below
``_least(P)`` need not be computed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.wordbytes import CASED, Words, byte_view, portions, rolled
from folioscope.session import durable

#: Whole periods and words that a run has at least.
PERIODS, WORDS = 4, 6
#: Boundary-period pairs looked at at once; what tiles in different parts of a long text find is stitched after the shuffle.
CELLS = 1 << 20

_PRIMES = (np.uint64(2147483647), np.uint64(2147483629))
_BASES = (np.uint64(1103515245), np.uint64(1812433253))
_FRAGMENT = "array<struct<period: bigint, start: bigint, stop: bigint>>"
_RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _least(octave: int) -> int:
    return min(2 * octave + 1, 8)


class _Prefixes:
    """Polynomial prefix hashes modulo two primes (62 bits together): equality of stretches of words in constant time."""

    def __init__(self, hashes: np.ndarray):
        self.powers, self.sums = [], []
        for k, (prime, base) in enumerate(zip(_PRIMES, _BASES, strict=True)):
            powers = np.ones(len(hashes) + 1, np.uint64)
            done, step = 1, base % prime
            while done < len(powers):  # b**0 .. b**(done - 1) are known; step is b**done
                more = min(done, len(powers) - done)
                powers[done : done + more] = powers[:more] * step % prime
                done, step = done + more, step * step % prime
            values = (hashes >> np.uint64(32 * k)) % prime
            sums = np.zeros(len(hashes) + 1, np.uint64)
            np.cumsum(values * powers[:-1] % prime, out=sums[1:])
            self.powers.append(powers)
            self.sums.append(sums % prime)

    def same(self, at: np.ndarray, period: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the ``length`` words at ``at`` equal those ``period`` later."""
        equal = np.ones(len(at), bool)
        for prime, powers, sums in zip(_PRIMES, self.powers, self.sums, strict=True):
            here = (sums[at + length] + prime - sums[at]) % prime
            there = (sums[at + period + length] + prime - sums[at + period]) % prime
            equal &= here * powers[period] % prime == there
        return equal

    def reach(self, at: np.ndarray, period: np.ndarray, known: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """The Z values: how many words from ``at`` on (or before it) equal those one period later; ``known`` at least, ``most`` at most."""
        low, high = known.copy(), most.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_] + 1) // 2
            begin = at[open_] - middle if back else at[open_]
            equal = self.same(begin, period[open_], middle)
            low[open_[equal]] = middle[equal]
            high[open_[~equal]] = middle[~equal] - 1
            open_ = open_[low[open_] < high[open_]]
        return low


def _merged(found: np.ndarray) -> np.ndarray:
    """Fragments (rows: document, period, start, stop, open at the left, open at the right) with those that touch made one."""
    doc, period, start, stop, left, right = found = found[:, np.lexsort((found[2], found[1], found[0]))]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (period[1:] != period[:-1])
    line = np.cumsum(fresh) * (stop.max() + 1)
    furthest = np.maximum.accumulate(line + stop)
    fresh[1:] |= furthest[:-1] < line[1:] + start[1:]
    first = np.flatnonzero(fresh)
    ends = np.maximum.reduceat(stop, first)
    at_end = stop == np.repeat(ends, np.diff(np.append(first, len(doc))))
    closed = np.maximum.reduceat(np.where(at_end, 1 - right, 0), first)  # some fragment saw the stretch end there
    at_start = start == np.repeat(start[first], np.diff(np.append(first, len(doc))))
    begun = np.maximum.reduceat(np.where(at_start, 1 - left, 0), first)
    return np.stack([doc[first], period[first], start[first], ends, 1 - begun, 1 - closed])


def _long_enough(period, start, stop):
    return (stop - start >= (PERIODS - 1) * period) & (stop - start + period >= WORDS)


def fragments(hashes: np.ndarray, first: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Fragments in all texts of a portion: rows document, period, start, stop, open at the left, open at the right.

    ``hashes`` are those of all words, text ``d`` has the words from ``first[d]`` to ``first[d + 1]``. Words start to
    stop - 1 of the document equal those one period later. Closed ones too short for a run are left out, as are
    closed ones over the same words as one of a smaller period.
    """
    n, sizes = len(hashes), np.diff(first)
    parts: list[np.ndarray] = []
    prefixes, grams, width = None, None, 0
    octave = 1
    while PERIODS * octave <= (sizes.max() if len(sizes) else 0):
        if _least(octave) != width:
            width = _least(octave)
            grams = rolled(hashes, width)
        rows = len(grams) // octave
        blocks = grams[: rows * octave].reshape(rows, octave)
        tail = grams[rows * octave :]  # the last block, if it isn't whole
        step = max(1, cells // octave)
        for begin in range(0, max(rows - 1, 0) + (len(tail) > 0), step):
            end = min(begin + step, rows - 1)
            hit, offset = np.nonzero(blocks[begin + 1 : end + 1] == blocks[begin:end, :1]) if begin < end else (np.zeros(0, np.int64),) * 2
            at, period = (begin + hit) * octave, octave + offset
            if len(tail) and rows and begin + step > rows - 1:
                more = np.flatnonzero(tail == blocks[rows - 1, 0])
                at, period = np.append(at, np.full(len(more), (rows - 1) * octave)), np.append(period, octave + more)
            if not len(at):
                continue
            doc = np.searchsorted(first, at, "right") - 1
            lo, hi = first[doc], first[doc + 1]
            fits = (at + period + width <= hi) & (PERIODS * period <= hi - lo)
            at, period, doc, lo, hi = at[fits], period[fits], doc[fits], lo[fits], hi[fits]
            if not len(at):
                continue
            prefixes = prefixes or _Prefixes(hashes)
            ahead, behind = np.minimum(2 * octave + width, hi - at - period), np.minimum(octave, at - lo)
            forward = prefixes.reach(at, period, np.full(len(at), width), ahead, back=False)
            backward = prefixes.reach(at, period, np.zeros(len(at), np.int64), behind, back=True)
            left = (backward == octave) & (at - octave > lo)
            right = (forward == 2 * octave + width) & (at + period + forward < hi)
            found = _merged(np.stack([doc, period, at - backward - lo, at + forward - lo, left.astype(np.int64), right.astype(np.int64)]))
            parts.append(found[:, _long_enough(*found[1:4]) | (found[4] > 0) | (found[5] > 0)])
        octave *= 2
    found = np.concatenate(parts, axis=1) if parts else np.zeros((6, 0), np.int64)
    doc, period, start, stop, left, right = found = found[:, np.lexsort((found[1], found[1] + found[3], found[2], found[0]))]
    again = np.zeros(len(doc), bool)
    again[1:] = (doc[1:] == doc[:-1]) & (start[1:] == start[:-1]) & ((stop + period)[1:] == (stop + period)[:-1])
    return found[:, ~again | (left > 0) | (right > 0)]


def _searched(docs: DataFrame, id_column: str, text_column: str, finish: Callable[[bytes], bytes] | None, kind: str) -> DataFrame:
    """(id, row, text, collapsed, fragments): ``text`` only of documents with fragments, ``collapsed`` only of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1):
            data, offsets = byte_view(batch.column(1))
            words = Words(data, offsets, CASED)
            doc, period, start, stop, _, _ = fragments(words.hash, words.first)
            texts, collapsed = [], []
            has = np.zeros(batch.num_rows, bool)
            has[doc] = True
            for k in range(batch.num_rows):
                joined = b" ".join(data[offsets[k] : offsets[k + 1]].tobytes().split())
                texts.append(joined if has[k] else None)
                collapsed.append(None if has[k] else finish(joined) if finish else joined)
            order = np.argsort(doc, kind="stable")
            ends = np.searchsorted(doc[order], np.arange(batch.num_rows + 1)).astype(np.int32)
            values = pa.StructArray.from_arrays([pa.array(x[order]) for x in (period, start, stop)], ["period", "start", "stop"])
            columns = [batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(collapsed, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, values)], ["id", "text", "collapsed", "fragments"])

    given = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    found = given.mapInArrow(run, f"id {kind}, text string, collapsed string, fragments {_FRAGMENT}")
    return durable(found.withColumn("row", F.monotonically_increasing_id()))


def stitched(fragments: DataFrame) -> DataFrame:
    """(row, start, length, period) of every run, from fragments (row, period, start, stop) in any number of pieces."""
    order = Window.partitionBy("row", "period").orderBy("start")
    furthest = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = fragments.withColumn("fresh", F.coalesce((F.col("start") > furthest).cast("long"), F.lit(1)))
    islands = islands.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = islands.groupBy("row", "period", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    long_enough = whole.where(_long_enough(F.col("period"), F.col("start"), F.col("stop")))
    # A multiple of a run's period has the same words as the run.
    return long_enough.groupBy("row", "start", (F.col("stop") - F.col("start") + F.col("period")).alias("length")).agg(F.min("period").alias("period"))


def _without(words: list[bytes], runs: list[dict]) -> bytes:
    gone = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        gone[r["start"] + r["period"]] += 1
        gone[r["start"] + r["length"]] -= 1
    kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    return b" ".join([words[k] for k in kept.tolist()])


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", finish: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """One row per row of ``docs``: (id column, runs, collapsed).

    ``runs`` are (start, length, period) in words ``[^\\x20\\x09-\\x0D]+``, by start, then period, each with its smallest
    period. ``collapsed`` are the words, joined by one space, that no run contains after its first period;
    ``finish`` is applied to each of them inside the task, for instance to keep a digest only. Null is a text without
    words. Repeated rows are told apart, null ids are kept; other columns of ``docs``, whatever their names, aren't read.
    Texts without fragments aren't shuffled, and with ``finish`` not stored either. Nothing is capped: a text of one
    repeated word costs n log n as any other.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    searched = _searched(docs, id_column, text_column, finish, kind)
    plain = searched.where("text is null").select("id", F.array().cast(_RUN).alias("runs"), "collapsed")
    runs = stitched(searched.where("text is not null").select("row", F.inline("fragments")))
    by_start = F.sort_array(F.collect_list(F.struct("start", "period", "length")))
    in_order = F.transform(by_start, lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period")))
    of_row = runs.groupBy("row").agg(in_order.alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1):
            collapsed = []
            for text, own in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                left = _without(text.split(), own)
                collapsed.append(finish(left) if finish else left)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(collapsed, pa.binary()).cast(pa.string())], ["id", "runs", "collapsed"])

    found = searched.where("text is not null").join(of_row, "row", "left")
    cut = found.select("id", "text", F.coalesce("runs", F.array().cast(_RUN)).alias("runs")).mapInArrow(run, f"id {kind}, runs {_RUN}, collapsed string")
    return plain.unionByName(cut).withColumnRenamed("id", id_column)
