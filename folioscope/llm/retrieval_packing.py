"""Packing of documents into token windows with lexically close documents side by side.

Documents are dealt by range of a lexical signature (their most telling terms), so that close ones meet.
Each task reads its range shard by shard, makes a BM25 inverted index of a shard and packs it: a seed
document's most telling terms are asked of the index, and the best unused neighbours fill the seed's window. The
neighbour that overfills it is cut; its rest is the next seed. Statistics of terms cover the whole corpus.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.wordbytes import BLANKS, Words, byte_view, portions
from folioscope.session import discard, durable

WINDOW = 4096
#: Tokens of a shard, which is indexed and packed at once; a longer document is a shard of its own.
SHARD_TOKENS = 1 << 21
#: Terms of a seed that its neighbours are found by.
QUERY_TERMS = 24
K1, B = 1.2, 0.75
#: Words whose tokens a worker process keeps (about 24 bytes each); when there are more, it starts anew.
KEPT = 3 << 19
#: Words that go to the tokenizer as one text.
JOINED = 1024


class WordTokens:
    """Token ids of texts, by words: each distinct word goes to the tokenizer once. Words are told apart by 64-bit hashes.

    The tokenizer must drop white space, take words between blanks by themselves and not tell A-Z from a-z; others are refused.
    If it also parts signs from letters, a sign that ends a word is a word of its own, so fewer words are distinct.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        apart = [i for w in ("it's", "Été", "a1!", "'d", "́x") for i in self._ids([w])[0]]
        if self._ids([" IT'S\tÉté \n\nA1! 'd ́x"])[0] != apart:
            raise ValueError(f"{path}: the tokens of a word depend on its case or on what stands around it")
        self.kind = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.parted = all(self._parts(letter + sign) for letter in ("a", "ab", "9", "é", "я") for sign in ".,;:!?")
        mark = self._ids(["\x01"])[0]
        self.mark = mark[0] if len(mark) == 1 else None
        self._clear()

    def _parts(self, word: str) -> bool:
        """Whether the last sign is a piece of its own that changes nothing before it."""
        pieces = lambda w: [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(w)] if self.library.pre_tokenizer else [w]
        return pieces(word) == pieces(word[:-1]) + pieces(word[-1]) and self._ids([word])[0] == [i for w in self._ids([word[:-1], word[-1]]) for i in w]

    def _ids(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def _clear(self) -> None:
        self.keys, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        self.ids = np.zeros(0, self.kind)

    def _of_words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in a row and how many each has. Some words go to the tokenizer as one text, with a mark after each."""
        size = end - start
        behind = np.cumsum(size + 3)
        text = np.full(int(behind[-1]), ord(" "), np.uint8)
        text[behind - 2] = 1
        before = np.cumsum(size) - size
        each = np.arange(int(size.sum()))
        text[each + np.repeat(behind - 3 - size - before, size)] = data[each + np.repeat(start - before, size)]
        cuts = [0, *behind[JOINED - 1 :: JOINED].tolist(), len(text)]
        found = self._ids([text[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:]) if a < b]) if self.mark is not None else []
        ids = np.fromiter(chain.from_iterable(found), np.int64, sum(map(len, found)))
        marks = np.flatnonzero(ids == self.mark)
        if len(marks) == len(size):
            return ids[ids != self.mark].astype(self.kind), np.diff(marks, prepend=-1) - 1
        found = self._ids([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start, end, strict=True)])  # a word has the mark itself
        sizes = np.array([len(x) for x in found], np.int64)
        return np.fromiter(chain.from_iterable(found), self.kind, int(sizes.sum())), sizes

    def _learn(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        ids, sizes = self._of_words(data, start, end)
        begin = len(self.ids) + np.cumsum(sizes) - sizes
        self.ids = np.concatenate([self.ids, ids])
        at = np.searchsorted(self.keys, hashes)
        self.keys, self.begin, self.size = np.insert(self.keys, at, hashes), np.insert(self.begin, at, begin), np.insert(self.size, at, sizes)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each followed by ``end_id``, and where each text's begin (one more than texts)."""
        words = Words(data, offsets, BLANKS, self.parted)
        if len(self.keys) > KEPT or len(self.ids) > 8 * KEPT:
            self._clear()
        hashes, first, each = np.unique(words.hash, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, hashes)
        new = np.ones(len(at), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != hashes[inside]
        if new.any():
            places = first[new]
            self._learn(hashes[new], data, words.start[places], words.end[places])
            at = np.searchsorted(self.keys, hashes)
        sizes = self.size[at].astype(np.int64)[each]
        before = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.arange(before[-1]) + np.repeat(self.begin[at].astype(np.int64)[each] - before[:-1], sizes)]
        begins = before[words.first]  # of each text, without the end tokens
        return np.insert(ids, begins[1:], end_id), begins + np.arange(len(begins))


@functools.lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    """One for all tasks of a worker process."""
    return WordTokens(path)


def _terms(ids: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of the distinct terms of each document, by document and term; end tokens are no terms."""
    doc = np.repeat(np.arange(len(begins) - 1), np.diff(begins) - 1)
    inside = np.ones(len(ids), bool)
    inside[begins[1:] - 1] = False
    keys = np.sort(doc.astype(np.uint64) << np.uint64(32) | ids[inside].astype(np.uint64))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(keys)))
    return (keys[first] >> np.uint64(32)).astype(np.int64), (keys[first] & np.uint64(0xFFFFFFFF)).astype(np.int64), counts


def tokenized(docs: DataFrame, id_column: str, text_column: str, path: str, end_id: int) -> DataFrame:
    """(id, tokens, n, df), stored: a row for each document with its ids as little-endian bytes, and rows with document counts of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(path)
        seen = np.zeros(words.library.get_vocab_size(), np.int64)
        kind = None
        for batch in portions(batches, 1):
            kind = batch.schema.field(0).type
            data, offsets = byte_view(batch.column(1))
            ids, begins = words.encode(data, offsets, end_id)
            seen += np.bincount(_terms(ids, begins)[1], minlength=len(seen))
            tokens = _binary(ids, begins)
            yield pa.RecordBatch.from_arrays([batch.column(0), tokens, pa.array(np.diff(begins)), pa.nulls(len(tokens), pa.binary())], names)
        if kind is None:
            return
        yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([seen.tobytes()], pa.binary())], names)

    names = ["id", "tokens", "n", "df"]
    id_kind = docs.schema[id_column].dataType.simpleString()
    given = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return durable(given.mapInArrow(run, f"id {id_kind}, tokens binary, n long, df binary"))


def _binary(ids: np.ndarray, begins: np.ndarray) -> pa.Array:
    ids = np.ascontiguousarray(ids)
    return pa.BinaryArray.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer((begins * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])


def document_counts(stored: DataFrame, vocabulary: int) -> tuple[np.ndarray, int, int]:
    """(documents with each term, documents, tokens); what comes to the driver has one number for each term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for counts in batch.column(0):
                total += np.frombuffer(counts.as_py(), np.int64)
        terms = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(total[terms])], ["term", "n"])

    summed = stored.where("df is not null").select("df").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(vocabulary, np.int64)
    seen[np.asarray(summed["term"])] = np.asarray(summed["n"])
    row = stored.where("tokens is not null").agg(F.count("*").alias("rows"), F.sum("n").alias("tokens")).first()
    return seen, row["rows"], row["tokens"] or 0


def _signed(stored: DataFrame, idf: np.ndarray, kind: np.dtype) -> DataFrame:
    """Add ``signature``: the three terms of a document with the greatest weight, as one number to sort by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_view(batch.column(1))
            doc, term, count = _terms(data.view(kind), offsets // kind.itemsize)
            weight = (1 + np.log(count)) * told.value[term]
            signature = np.zeros(batch.num_rows, np.int64)
            first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
            for _ in range(3):
                best = np.maximum.reduceat(weight, first) if len(first) else weight
                top = np.flatnonzero((weight == np.repeat(best, np.diff(np.append(first, len(doc))))) & (weight > 0))
                owner, one = np.unique(doc[top], return_index=True)
                signature <<= 21
                signature[owner] |= term[top[one]] + 1
                weight[top[one]] = 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(signature)], ["id", "tokens", "signature"])

    told = stored.sparkSession.sparkContext.broadcast(idf)
    given = stored.where("tokens is not null").select("id", "tokens")
    return given.mapInArrow(run, f"{given.schema[0].simpleString().replace(':', ' ')}, tokens binary, signature long")


class _Index:
    """A shard's inverted index and, by document, its terms with their BM25 weights."""

    def __init__(self, ids: np.ndarray, begins: np.ndarray, idf: np.ndarray, mean: float):
        doc, self.term, count = _terms(ids, begins)
        length = np.diff(begins) - 1
        self.weight = idf[self.term] * count * (K1 + 1) / (count + K1 * (1 - B + B * length[doc] / mean))
        self.of_doc = np.searchsorted(doc, np.arange(len(begins)))
        order = np.argsort(self.term, kind="stable")
        self.posted, self.posted_weight = doc[order], self.weight[order]
        self.of_term = np.searchsorted(self.term[order], np.arange(len(idf) + 1))

    def query(self, doc: int) -> np.ndarray:
        """The document's terms of greatest weight; of equal ones the smaller."""
        own = slice(self.of_doc[doc], self.of_doc[doc + 1])
        return self.term[own][np.argsort(-self.weight[own], kind="stable")[:QUERY_TERMS]]

    def scores(self, terms: np.ndarray, docs: int) -> np.ndarray:
        parts = [slice(self.of_term[t], self.of_term[t + 1]) for t in terms.tolist()]
        if not parts:
            return np.zeros(docs)
        return np.bincount(np.concatenate([self.posted[p] for p in parts]), np.concatenate([self.posted_weight[p] for p in parts]), minlength=docs)


class Packer:
    """Packs shard after shard; a window that a shard leaves open goes on with the next one's documents."""

    def __init__(self, window: int, idf: np.ndarray, mean: float, first_sequence: int):
        self.window, self.idf, self.mean = window, idf, mean
        self.sequence, self.filled = first_sequence, 0
        self.terms = np.zeros(0, np.int64)

    def pack(self, ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Rows (document, start, length, sequence, offset) for all documents of a shard."""
        docs, sizes = len(begins) - 1, np.diff(begins)
        index = _Index(ids, begins, self.idf, self.mean)
        unused = np.ones(docs, bool)
        pieces: list[tuple[int, int, int, int, int]] = []
        scores = index.scores(self.terms, docs) if self.filled else None
        following = 0

        def place(doc: int, start: int) -> int:
            """Put what fits of a document from ``start`` on; where its rest begins."""
            length = min(int(sizes[doc]) - start, self.window - self.filled)
            pieces.append((doc, start, length, self.sequence, self.filled))
            self.filled += length
            if self.filled == self.window:
                self.sequence, self.filled = self.sequence + 1, 0
            return start + length

        while True:
            if scores is not None and scores[best := int(scores.argmax())] > 0:
                doc = best
            else:
                while following < docs and not unused[following]:
                    following += 1
                if following == docs:
                    return np.array(pieces, np.int64).reshape(-1, 5)
                doc = following
            unused[doc] = False
            if scores is not None:
                scores[doc] = 0
            start = 0
            while start < sizes[doc]:
                if not self.filled:  # the document, or the rest of it, opens a window: the seed
                    self.terms = index.query(doc)
                    scores = None
                start = place(doc, start)
            if not self.filled:
                scores = None
            elif scores is None:
                scores = index.scores(self.terms, docs)
                scores[~unused] = 0


def _closed(pieces: np.ndarray, filled: int, sequence: int) -> np.ndarray:
    """The pieces with the last window, of ``filled`` tokens, parted into sequences whose lengths are powers of two."""
    last = pieces[:, 3] == sequence
    out, taken = [pieces[~last]], 0
    for power in (1 << k for k in reversed(range(filled.bit_length())) if filled >> k & 1):
        for doc, start, length, _, offset in pieces[last].tolist():
            low, high = max(offset, taken), min(offset + length, taken + power)
            if low < high:
                out.append(np.array([[doc, start + low - offset, high - low, sequence, low - taken]]))
        taken, sequence = taken + power, sequence + 1
    return np.concatenate(out)


def _shards(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids of the documents, tokens, begins) of about SHARD_TOKENS tokens each, in the order of the rows."""
    held: list[pa.RecordBatch] = []
    tokens = 0

    def shard() -> tuple[pa.Array, np.ndarray, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        data, offsets = byte_view(table["tokens"])
        return table["id"].combine_chunks(), data.view(kind), offsets // kind.itemsize

    for batch in batches:
        ends = np.cumsum(np.asarray(pc.binary_length(batch.column(1)), dtype=np.int64) // kind.itemsize)
        row, begin = 0, 0
        while row < batch.num_rows:
            stop = int(np.searchsorted(ends, begin + SHARD_TOKENS - tokens, "right"))
            if stop == row and not held:
                stop = row + 1
            if stop > row:
                held.append(batch.slice(row, stop - row))
                tokens += int(ends[stop - 1]) - begin
                row, begin = stop, int(ends[stop - 1])
            if row < batch.num_rows:
                yield shard()
                held, tokens = [], 0
    if held:
        yield shard()


def pack(
    docs: DataFrame, tokenizer_path: str, end_id: int, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW,
) -> DataFrame:
    """One row per piece: (id column, start, length, ids, doc_tokens, sequence_id, offset).

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit numbers, ``doc_tokens`` those of the whole document
    with its end token. Every id of every row lies in exactly one piece. Sequences have ``window`` ids; only the
    last window of a task's range may be open, and is parted into sequences whose lengths are powers of two, so that
    no padding is needed. Offsets are gapless from 0 in each sequence.

    Null is an empty text, which is its end token. Repeated rows are packed as often as they come, null ids are
    kept; other columns of ``docs``, whatever their names, aren't read. A hot signature is dealt on by
    content and row. Which documents meet depends on the ranges Spark samples: store the result before reading it twice.
    """
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(tokenizer_path).get_vocab_size()
    kind = np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")
    stored = tokenized(docs, id_column, text_column, tokenizer_path, end_id)
    seen, rows, tokens = document_counts(stored, vocabulary)
    idf = np.where(seen > 1, np.log1p((rows - seen + 0.5) / (seen + 0.5)), 0.0)  # a term of one document leads nowhere
    mean = max(1.0, (tokens - rows) / max(1, rows))
    signed = durable(_signed(stored, idf, kind).withColumn("content", F.xxhash64("tokens")).withColumn("row", F.monotonically_increasing_id()))
    discard(stored)
    told = docs.sparkSession.sparkContext.broadcast(idf)
    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, told.value, mean, TaskContext.get().partitionId() << 40)
        open_: tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray] | None = None  # documents of the window left open, with its pieces

        def told_out(ids: pa.Array, tokens: np.ndarray, begins: np.ndarray, pieces: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(pieces), 512):
                doc, start, length, sequence, offset = pieces[k : k + 512].T
                ends = np.concatenate([[0], np.cumsum(length)])
                own = tokens[np.arange(ends[-1]) + np.repeat(begins[doc] + start - ends[:-1], length)].astype("<u4")
                sizes = begins[doc + 1] - begins[doc]
                columns = [ids.take(pa.array(doc)), pa.array(start), pa.array(length), _binary(own, ends), pa.array(sizes), pa.array(sequence), pa.array(offset)]
                yield pa.RecordBatch.from_arrays(columns, names)

        for ids, tokens, begins in _shards(batches, kind):
            pieces = packer.pack(tokens, begins)
            if open_ and not (packer.filled and packer.sequence == open_[3][0, 3]):  # this shard has filled it
                yield from told_out(*open_)
                open_ = None
            last = (pieces[:, 3] == packer.sequence) if packer.filled else np.zeros(len(pieces), bool)
            yield from told_out(ids, tokens, begins, pieces[~last])
            if last.any():
                doc, at = np.unique(pieces[last, 0], return_inverse=True)
                kept = pieces[last].copy()
                kept[:, 0] = at
                sizes = np.diff(begins)[doc]
                own = np.concatenate([[0], np.cumsum(sizes)])
                some = tokens[np.arange(own[-1]) + np.repeat(begins[doc] - own[:-1], sizes)]
                open_ = _appended(open_, (ids.take(pa.array(doc)), some, own, kept))
        if open_:
            yield from told_out(*open_[:3], _closed(open_[3], packer.filled, packer.sequence))

    id_kind = docs.schema[id_column].dataType.simpleString()
    order = ("signature", "content", "row")
    dealt = signed.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "tokens")
    out = dealt.mapInArrow(run, f"id {id_kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_column)


def _appended(held: tuple | None, more: tuple) -> tuple:
    """Documents of one open window that come from several shards."""
    if held is None:
        return more
    pieces = more[3].copy()
    pieces[:, 0] += len(held[0])
    return pa.concat_arrays([held[0], more[0]]), np.concatenate([held[1], more[1]]), np.concatenate([held[2], held[2][-1] + more[2][1:]]), np.concatenate([held[3], pieces])
