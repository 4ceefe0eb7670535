"""Scoring of texts by prediction by partial matching over bytes, with escapes and symbol exclusion.

The context trie is a table of byte runs with counts, gathered over all training texts in one
shuffle. A text is scored by its bytes after ``ORDER`` start marks and an end mark. A byte seen in its
longest known context has probability (2c - 1) / 2T: c its count, T all counts there. Else the escape
u / 2T is paid (u: the number of distinct symbols there) and the next shorter context is asked, without
the symbols that the longer one had already offered. Under the empty context all remaining symbols are equal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.tables import find, hash_table
from folioscope.llm.wordbytes import BLANKS, CHUNK, Words, byte_view
from folioscope.session import discard, durable

#: Bytes of context.
ORDER = 5
#: Trie leaves told to all tasks at a time (about 80 bytes each with their index). A larger trie takes several passes, each with the contexts of some last bytes.
LEAVES_TOLD = 4_000_000
#: The most frequent words are told to all tasks (16 bytes each); the counts of all others are joined.
WORDS_TOLD = 1 << 19

START, END = 0xFE, 0xFF  # bytes that UTF-8 never uses
SYMBOLS = 255  # all bytes but START
_WORD, _GRAM, _TEXT = 0, 1, 2


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of runs of whole texts of about CHUNK bytes; each run's offsets begin at 0."""
    text = 0
    while text < len(offsets) - 1:
        stop = max(text + 1, int(np.searchsorted(offsets, offsets[text] + CHUNK, "right")) - 1)
        yield data[offsets[text] : offsets[stop]], offsets[text : stop + 1] - offsets[text]
        text = stop


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every predicted symbol with its context as one number (context bytes, then the symbol), and where each text's begin."""
    size = np.diff(offsets)
    texts = len(size)
    starts = offsets[:-1] + np.arange(texts) * (ORDER + 1)
    padded = np.full(int(size.sum()) + texts * (ORDER + 1), START, np.uint8)
    place = np.arange(int(size.sum())) + np.repeat((np.arange(texts) + 1) * (ORDER + 1) - 1, size)
    padded[place] = data
    padded[starts + ORDER + size] = END
    keys = padded[: len(padded) - ORDER].astype(np.uint64)
    for k in range(1, ORDER + 1):
        keys <<= np.uint64(8)
        keys |= padded[k : len(padded) - ORDER + k]
    inside = np.ones(len(keys), bool)
    cut = (starts[1:, None] - ORDER + np.arange(ORDER)).ravel()  # runs that end in the next text's start marks
    inside[cut] = False
    return keys[inside], np.concatenate([[0], np.cumsum(size + 1)])


class _Tally:
    """Counts of keys over the pieces of a task, merged now and then."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> None:
        own, n = np.unique(keys, return_counts=True)
        self.keys.append(own)
        self.counts.append(n)
        self.held += len(own)
        if self.held > 1 << 21:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.counts = [keys[first]], [np.add.reduceat(counts, first) if len(first) else counts]
        self.held = len(first)
        return self.keys[0], self.counts[0]


def gather(docs: DataFrame, text_column: str) -> DataFrame:
    """(kind, key, n): counts over all texts of word hashes, of symbols with their contexts, and of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams, texts = _Tally(), _Tally(), 0

        def flush(kind: int, tally: _Tally) -> pa.RecordBatch:
            keys, n = tally.merge()
            tally.__init__()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["kind", "key", "n"])

        for batch in batches:
            data, offsets = byte_view(batch.column(0))
            texts += batch.num_rows
            for piece, own in _pieces(data, offsets):
                grams.add(_runs(piece, own)[0])
                words.add(Words(piece, own, BLANKS).hash)
            for kind, tally in ((_WORD, words), (_GRAM, grams)):
                if tally.held > 1 << 21:
                    yield flush(kind, tally)
        yield flush(_WORD, words)
        yield flush(_GRAM, grams)
        yield pa.RecordBatch.from_arrays([pa.array([_TEXT], pa.int32()), pa.array([0]), pa.array([texts])], ["kind", "key", "n"])

    return docs.select(text_column).mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """A trained model: the stored table of ``gather`` and its totals."""

    counts: DataFrame
    tokens: int
    distinct: int
    leaves: int
    symbols: np.ndarray  # counts under the empty context, by byte


def train(docs: DataFrame, text_column: str = "text") -> Model:
    """Learn from all rows of ``docs``; null is an empty text. Counts are kept as a table in the shared folder."""
    counts = durable(gather(docs, text_column).where("n > 0"))
    totals = {r["kind"]: (r["n"], r["keys"]) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("keys")).collect()}
    words, texts, leaves = (totals.get(k, (0, 0)) for k in (_WORD, _TEXT, _GRAM))
    symbols = np.zeros(256, np.int64)
    for r in counts.where(F.col("kind") == _GRAM).groupBy((F.col("key") % 256).alias("b")).agg(F.sum("n").alias("n")).collect():
        symbols[r["b"]] = r["n"]
    return Model(counts, words[0] + texts[0], words[1] + (texts[0] > 0), leaves[1], symbols)


def _suffix_counts(keys: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the last ``size`` bytes of the keys."""
    own = keys & np.uint64((1 << 8 * size) - 1)
    order = np.argsort(own, kind="stable")
    own, counts = own[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return own[first], np.add.reduceat(counts, first)


def _at(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == keys, at, -1)


def _trie(keys: np.ndarray, counts: np.ndarray, symbols: np.ndarray) -> dict:
    """Log10 tables of the trie with these leaves, their keys ascending.

    ``leaves``: hash table of the log probability of each leaf. ``grams[j]`` of the shorter contexts: (context of
    j bytes and symbol, log count). ``contexts[j]``: contexts of j bytes with log total and log escape, alone and as
    what a longer context of the same text leaves of the next shorter one. Levels are made one after the other,
    and only the counts of the one before are held.
    """
    seen = np.flatnonzero(symbols).astype(np.uint64)
    grams: list[tuple[np.ndarray, np.ndarray]] = []
    contexts: list[dict] = []
    below: tuple = ()
    with np.errstate(divide="ignore"):
        for j in range(ORDER + 1):
            if j == 0:
                own, n = seen, symbols[symbols > 0]
            else:
                own, n = _suffix_counts(keys, counts, j + 1) if len(keys) and j < ORDER else (keys, counts)
            context = own >> np.uint64(8)
            first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(own) else np.zeros(0, np.int64)
            context = context[first]
            total = np.add.reduceat(n, first) if len(first) else n
            kinds = np.diff(np.append(first, len(own)))
            all_ = np.log10(2 * total)
            level = {"keys": context, "escape": np.log10(kinds) - all_}
            if j:
                short_own, short_n, short_context, short_total, short_kinds = below
                offered = short_n[_at(short_own, own & np.uint64((1 << 8 * j) - 1))]
                offered = np.add.reduceat(offered, first) if len(first) else n
                parent = _at(short_context, context & np.uint64((1 << 8 * (j - 1)) - 1))
                left_kinds = short_kinds[parent] - kinds
                left = short_total[parent] - offered
                level["left_all"] = np.log10(np.maximum(2 * left, 1))
                level["left_escape"] = np.where(left_kinds > 0, np.log10(np.maximum(left_kinds, 1)) - level["left_all"], 0.0)
                del offered, parent, left_kinds, left
            contexts.append(level)
            if j < ORDER:
                level["all"] = all_
                grams.append((own, np.log10(2 * n - 1)))
                below = own, n, context, total, kinds
        below = ()
        value = np.log10(2 * counts - 1)
    value -= np.repeat(all_, kinds)
    del first, context, total, all_, kinds
    return {"leaves": hash_table(keys, value), "grams": grams, "contexts": contexts, "last": -math.log10(SYMBOLS - len(seen)) if len(seen) < SYMBOLS else 0.0}


def _trie_of(leaves: pa.Table, symbols: np.ndarray) -> dict:
    """``_trie`` of the leaves (key, n), in any order."""
    keys = np.asarray(leaves["key"]).view(np.uint64)
    order = np.argsort(keys)
    return _trie(keys[order], np.asarray(leaves["n"])[order], symbols)


def _escaped(trie: dict, keys: np.ndarray) -> np.ndarray:
    """Log10 probability of symbols that are no leaf, by the walk from the longest context to the empty one."""
    out = np.zeros(len(keys))
    rest, child = np.arange(len(keys)), np.full(len(keys), -1)
    for j in range(ORDER, -1, -1):
        level = trie["contexts"][j]
        key = keys[rest] & np.uint64((1 << 8 * (j + 1)) - 1)
        context = _at(level["keys"], key >> np.uint64(8))
        known, below = context >= 0, child >= 0
        alone, after = known & ~below, known & below
        value = np.zeros(len(rest))
        hit = np.zeros(len(rest), bool)
        if j < ORDER:
            own, count = trie["grams"][j]
            gram = _at(own, key)
            hit = gram >= 0
            value[hit] = count[gram[hit]]
            value[hit & alone] -= level["all"][context[hit & alone]]
            deeper = trie["contexts"][j + 1]
            value[hit & after] -= deeper["left_all"][child[hit & after]]
            value[~hit & after] = deeper["left_escape"][child[~hit & after]]
        value[~hit & alone] = level["escape"][context[~hit & alone]]
        out[rest] += value
        rest, child = rest[~hit], np.where(known, context, -1)[~hit]
    out[rest] += trie["last"]
    return out


def _scored(docs: DataFrame, text_column: str, trie: dict, words: tuple[np.ndarray, np.ndarray] | None, last_bytes: np.ndarray) -> tuple[DataFrame, Broadcast]:
    """Add to ``score`` what symbols after the context bytes ``last_bytes`` give, and with ``words`` the tokens' sums; and what is told to all tasks."""
    told = docs.sparkSession.sparkContext.broadcast((trie, hash_table(*words) if words else None, last_bytes))
    names = docs.columns
    texts, score = names.index(text_column), names.index("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, words, last_bytes = told.value
        for batch in batches:
            data, offsets = byte_view(batch.column(texts))
            columns = list(batch.columns)
            sums, tokens, known, base, rare = [], [], [], [], []
            for piece, begins in _pieces(data, offsets):
                keys, first = _runs(piece, begins)
                mine = last_bytes[(keys >> np.uint64(8)).astype(np.uint8)]
                value = np.zeros(len(keys))
                found, leaf = find(trie["leaves"], keys)
                value[found] = leaf[found]
                odd = ~found & mine
                value[odd] = _escaped(trie, keys[odd])
                value[~mine] = 0
                sums.append(np.add.reduceat(value, first[:-1]))
                if words is not None:
                    own = Words(piece, begins, BLANKS)
                    hit, log = find(words, own.hash)
                    log[~hit] = 0
                    total, hits = np.concatenate([[0.0], np.cumsum(log)]), np.concatenate([[0], np.cumsum(hit)])
                    f = own.first
                    tokens.append(f[1:] - f[:-1] + 1)
                    base.append(total[f[1:]] - total[f[:-1]])
                    known.append(hits[f[1:]] - hits[f[:-1]])
                    unseen = pa.array(own.hash[~hit].view(np.int64))
                    rare.append(pa.ListArray.from_arrays((f - hits[f]).astype(np.int32), unseen))
            if sums:
                columns[score] = pa.array(np.asarray(columns[score]) + np.concatenate(sums))
                if words is not None:
                    for name, parts in (("n_tokens", tokens), ("n_known", known), ("base_score", base)):
                        kind = pa.float64() if name == "base_score" else pa.int64()
                        columns[names.index(name)] = pa.array(np.concatenate(parts), kind)
                    columns[names.index("rare")] = pa.concat_arrays(rare).cast(batch.schema.field("rare").type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema), told


def _passes(model: Model, leaves_told: int) -> list[np.ndarray]:
    """Which last context bytes each pass has: as few passes as keep its leaves within the limit, or one byte each."""
    sizes = np.zeros(256, np.int64)
    if model.leaves > leaves_told:
        last = F.shiftrightunsigned("key", 8) % 256
        for r in model.counts.where(F.col("kind") == _GRAM).groupBy(last.alias("b")).count().collect():
            sizes[r["b"]] = r["count"]
    passes, held = [np.zeros(256, bool)], 0
    for b in range(256):
        if held and held + sizes[b] > leaves_told:
            passes.append(np.zeros(256, bool))
            held = 0
        passes[-1][b] = True
        held += sizes[b]
    return passes


def score(docs: DataFrame, model: Model, text_column: str = "text", leaves_told: int = LEAVES_TOLD, words_told: int = WORDS_TOLD) -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score and score (log10 probability by the trie).

    Null is an empty text; it has one token, the end. Every row is returned, repeated ones as often
    as they come; columns of ``docs`` with these names are replaced. Nothing of the trie is dropped: what
    doesn't fit one pass is told in several, and words beyond the told ones are joined by hash.
    """
    added = {"n_tokens": "long", "n_known": "long", "base_score": "double", "score": "double", "rare": "array<long>"}
    kept = [c for c in docs.columns if c not in (*added, "train_tokens", "row")]
    state = docs.select(*kept, *(F.lit(None if k == "rare" else 0).cast(v).alias(k) for k, v in added.items()))
    leaves = model.counts.where(F.col("kind") == _GRAM)
    frequent = model.counts.where(F.col("kind") == _WORD).orderBy(F.desc("n"), "key").limit(words_told).toArrow()
    words = np.asarray(frequent["key"]).view(np.uint64), np.log10(np.asarray(frequent["n"], dtype=np.float64) + 1)
    passes = _passes(model, leaves_told)
    for k, last_bytes in enumerate(passes):
        own = leaves if len(passes) == 1 else leaves.where((F.shiftrightunsigned("key", 8) % 256).isin(np.flatnonzero(last_bytes).tolist()))
        after, told = _scored(state, text_column, _trie_of(own.select("key", "n").toArrow(), model.symbols), words if k == 0 else None, last_bytes)
        if k == len(passes) - 1:
            after = after.drop(text_column)
        before, state = state, durable(after.withColumn("row", F.monotonically_increasing_id()) if k == len(passes) - 1 else after)
        told.destroy()
        if k:
            discard(before)
    log_all = math.log10(model.tokens + model.distinct + 1)
    ends = int(model.symbols[END])  # the count of the end token
    others = model.counts.where(F.col("kind") == _WORD).select(F.col("key").alias("h"), "n")
    more = (
        state.select("row", F.explode("rare").alias("h"))
        .groupBy("row", "h")
        .agg(F.count("*").alias("m"))
        .join(others, "h")
        .groupBy("row")
        .agg(F.sum(F.col("m") * F.log10(F.col("n") + 1)).alias("more"), F.sum("m").alias("found"))
    )
    full = state.join(more, "row", "left")
    return full.select(
        *(c for c in kept if c != text_column),
        "n_tokens",
        (F.col("n_known") + F.coalesce("found", F.lit(0)) + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more", F.lit(0.0)) + math.log10(ends + 1) - F.col("n_tokens") * log_all).alias("base_score"),
        "score",
    )


def adaptive_score(text: str | None, order: int = ORDER) -> float:
    """Log10 probability of one text by a trie that starts empty and learns each symbol after coding it."""
    seen: list[dict[bytes, dict[int, int]]] = [{} for _ in range(order + 1)]
    past, total = bytes([START] * order), 0.0
    for symbol in [*(text or "").encode(), END]:
        left: set[int] = set()
        for j in range(order, -1, -1):
            counts = seen[j].get(past[order - j :])
            if not counts:
                continue
            open_counts = {s: c for s, c in counts.items() if s not in left}
            if not open_counts:
                continue
            room = 2 * sum(open_counts.values())
            if symbol in open_counts:
                total += math.log10((2 * open_counts[symbol] - 1) / room)
                break
            total += math.log10(len(open_counts) / room)
            left.update(open_counts)
        else:
            total -= math.log10(SYMBOLS - len(left))
        for j in range(order + 1):
            node = seen[j].setdefault(past[order - j :], {})
            node[symbol] = node.get(symbol, 0) + 1
        past = (past + bytes([symbol]))[1:]
    return total


def adaptive_scores(docs: DataFrame, text_column: str = "text", order: int = ORDER) -> DataFrame:
    """``docs`` with ``adaptive_score``: each text's log10 probability by a trie of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [adaptive_score(t, order) for t in batch.column(batch.schema.get_field_index(text_column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "adaptive_score"])

    base = docs.drop("adaptive_score")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(run, f"{fields}, adaptive_score double")
