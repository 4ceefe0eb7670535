"""Benchmark decontamination: broadcast windows of benchmark words, scan the documents, verify, remove."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.wordbytes import NON_ALPHANUMERIC, Words, byte_view, portions, rolled
from folioscope.session import discard, durable

#: Windows told to all tasks at a time (about 100 bytes each). More windows make more passes over the documents.
WINDOWS_TOLD = 250_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_FOUND = "_items_found"
_SPANS = "_spans_found"


def windows(items: DataFrame, id_column: str, text_column: str, width: int) -> DataFrame:
    """(item_id, gram): distinct windows of ``width`` words of each item, words joined by blanks.

    An item of fewer words is one window; one without words has none.
    """
    lower = F.translate(F.col(text_column), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = items.select(
        F.col(id_column).cast("string").alias("item_id"),
        F.regexp_extract_all(lower, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)")).alias("w"),
    ).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(width - 1), F.lit(1)))
    each = words.select("item_id", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, width), " "))).alias("gram"))
    return each.distinct()


#: Per number of words: ascending hashes, the windows' bytes, and the items of each.
_Block = dict[int, tuple[np.ndarray, list[bytes], list[list[str]]]]


def _block(rows: pa.Table) -> _Block:
    """The windows of one pass."""
    grams: dict[bytes, list[str]] = {}
    for gram, item in zip(rows["gram"].to_pylist(), rows["item_id"].to_pylist(), strict=True):
        grams.setdefault(gram.encode(), []).append(item)
    sized: dict[int, list[bytes]] = {}
    for gram in grams:
        sized.setdefault(gram.count(b" ") + 1, []).append(gram)
    block = {}
    for width, own in sized.items():
        data, offsets = byte_view(pa.array(own, pa.binary()))
        hashes = rolled(Words(data, offsets, NON_ALPHANUMERIC).hash, width)[::width]
        order = np.argsort(hashes, kind="stable")
        block[width] = hashes[order], [own[i] for i in order], [grams[own[i]] for i in order]
    return block


def _hits(block: _Block, data: np.ndarray, words: Words) -> Iterator[tuple[int, int, list[str]]]:
    """(first word, number of words, items) of every window of the batch that is in the set."""
    for width, (hashes, grams, items) in block.items():
        runs = rolled(words.hash, width)
        if not len(runs):
            continue
        at = np.searchsorted(hashes, runs)
        at[at == len(hashes)] = 0
        for w in np.flatnonzero(hashes[at] == runs).tolist():
            text = np.searchsorted(words.first, w, "right")
            if w + width > words.first[text]:
                continue  # runs into the next text
            exact = b" ".join(bytes(data[words.start[k] : words.end[k]]) for k in range(w, w + width)).translate(_LOWER)
            k = int(at[w])
            while k < len(hashes) and hashes[k] == runs[w]:
                if grams[k] == exact:
                    yield w, width, items[k]
                k += 1


def _scan(docs: DataFrame, text_column: str, block: _Block) -> DataFrame:
    """Add what the block's windows find to ``_items_found`` and ``_spans_found`` (first word, end) of each row."""
    told = docs.sparkSession.sparkContext.broadcast(block)
    place = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, place):
            data, offsets = byte_view(batch.column(place))
            words = Words(data, offsets, NON_ALPHANUMERIC)
            items, spans = {}, {}
            for w, width, ids in _hits(told.value, data, words):
                text = int(np.searchsorted(words.first, w, "right")) - 1
                items.setdefault(text, set()).update(ids)
                spans.setdefault(text, []).append([w - int(words.first[text]), w - int(words.first[text]) + width])
            n = batch.num_rows
            old = batch.column(batch.schema.get_field_index(_FOUND)), batch.column(batch.schema.get_field_index(_SPANS))
            new = [old[0], old[1]]
            if items:
                was = old[0].to_pylist(), old[1].to_pylist()
                new[0] = pa.array([sorted({*was[0][i], *items.get(i, ())}) for i in range(n)], old[0].type)
                new[1] = pa.array([_merged([*was[1][i], *spans.get(i, ())]) for i in range(n)], old[1].type)
            columns = [*batch.columns[:-3], new[0], new[1], pa.array(words.counts(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def _merged(spans: list) -> list:
    out: list = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def find_windows(
    docs: DataFrame, items: DataFrame, text_column: str = "text", item_id_column: str = "item_id", item_text_column: str = "text",
    width: int = 10, windows_told: int = WINDOWS_TOLD,
) -> DataFrame:
    """``docs`` with ``_items_found`` (ids as strings, ascending), ``_spans_found`` (hit word ranges, merged) and ``_n_words``.

    Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` with A-Z as a-z. The windows' hashes are broadcast, at
    most ``windows_told`` at a time; a larger benchmark takes several passes, each written before the
    next. Every hash hit is compared word for word. Every row is returned, repeated rows as often as
    they come; a null or empty text has no words. An item without an id still marks words but is not
    listed. Columns of ``docs`` with the added names are replaced.
    """
    grams = durable(windows(items, item_id_column, item_text_column, width))
    blocks = max(1, -(-grams.count() // windows_told))
    state = docs.drop(_FOUND, _SPANS, "_n_words").withColumns(
        {_FOUND: F.array().cast(T.ArrayType(T.StringType())), _SPANS: F.array().cast("array<array<int>>"), "_n_words": F.lit(0).cast("long")}
    )
    for k in range(blocks):
        own = grams.where(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == k) if blocks > 1 else grams
        after = _scan(state, text_column, _block(own.withColumn("item_id", F.coalesce("item_id", F.lit("\0"))).toArrow()))
        before, state = state, durable(after) if k < blocks - 1 else after
        if k < blocks - 1:
            discard(before)
    discard(grams)
    return state.withColumn(_FOUND, F.array_remove(_FOUND, "\0"))


def contamination(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside any occurrence), n_items, items_sha256, contaminated."""
    found = find_windows(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")), items, **options)
    hit = F.aggregate(_SPANS, F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size(_FOUND).cast("long").alias("n_items"),
        F.sha2(F.array_join(_FOUND, ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, columns unchanged, whose text holds no benchmark window."""
    return find_windows(docs, items, text_column, **options).where(F.size(_SPANS) == 0).drop(_FOUND, _SPANS, "_n_words")


def cut_spans(docs: DataFrame, items: DataFrame, text_column: str = "text", **options) -> DataFrame:
    """``docs`` with every hit word range cut out of the text, from its first word's start to its last word's end."""
    found = find_windows(docs, items, text_column, **options)
    names = found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_view(batch.column(names.index(text_column)))
            words = Words(data, offsets, NON_ALPHANUMERIC)
            texts = batch.column(names.index(text_column)).to_pylist()
            for i, spans in enumerate(batch.column(names.index(_SPANS)).to_pylist()):
                if spans:
                    kept, last = [], offsets[i]
                    for a, b in spans:
                        kept.append(bytes(data[last : words.start[words.first[i] + a]]))
                        last = words.end[words.first[i] + b - 1]
                    texts[i] = b"".join([*kept, bytes(data[last : offsets[i + 1]])]).decode()
            columns = list(batch.columns)
            columns[names.index(text_column)] = pa.array(texts, batch.schema.field(text_column).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return found.mapInArrow(run, found.schema).drop(_FOUND, _SPANS, "_n_words")


def items_digest(ids: list) -> str:
    """What ``items_sha256`` holds for these item ids."""
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
