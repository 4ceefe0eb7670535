"""Token counts by a compiled finite-state transducer.

The splitting pattern of byte-level BPE is compiled to a deterministic transducer over character
classes whose transitions say where a piece begins. A batch of texts is cut into chunks of equal
length; every chunk's map from entry state to exit state is computed for all states at once, the maps
are composed by a parallel prefix scan, and with its entry state known each chunk is read a second
time for the output. A transition that closes a piece emits that piece's number of tokens, which the
merges give once for each distinct piece and which is kept for the next.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.tables import find, hash_table
from folioscope.llm.wordbytes import CHUNK, mixed

#: Characters a chunk of the scan has.
STEP = 256
_SETTLE = 16
#: Distinct pieces whose counts a worker keeps; when there are more, it starts anew.
KEPT = 1 << 21

# Character classes. Single-letter endings of contractions, first and second letters of the others.
LETTER, ONE, R, V, L2, E, NUMBER, SPACE, BLANK, QUOTE, OTHER, STOP = range(12)
# States: what has been read of the open piece.
(BEGIN, LETTERS, NUMBERS, OTHERS, DONE, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L, ONE_SPACE, SPACES, ONE_BLANK, BLANKS_) = range(13)
HERE, BEFORE = 1, 2  # outputs: a piece begins at this character, or at the one before


def compile_splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, output) by state and class, for the pattern
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.

    A run of blanks gives its last character to what follows, which is known only one character later:
    hence the output BEFORE.
    """
    letters = (LETTER, ONE, R, V, L2, E)
    run_of = {**dict.fromkeys(letters, LETTERS), NUMBER: NUMBERS, OTHER: OTHERS, QUOTE: QUOTED, SPACE: ONE_SPACE, BLANK: ONE_BLANK}
    to = np.zeros((13, 12), np.int64)
    out = np.zeros((13, 12), np.int64)
    for state in range(13):
        for kind in range(11):
            to[state, kind], out[state, kind] = run_of[kind], HERE
        to[state, STOP], out[state, STOP] = BEGIN, HERE
    for kind in letters:
        to[LETTERS, kind], out[LETTERS, kind] = LETTERS, 0
    to[NUMBERS, NUMBER], out[NUMBERS, NUMBER] = NUMBERS, 0
    for state in (OTHERS, QUOTED):
        for kind in (OTHER, QUOTE):
            to[state, kind], out[state, kind] = OTHERS, 0
    for kind, state in ((ONE, DONE), (R, QUOTED_R), (V, QUOTED_V), (L2, QUOTED_L)):
        to[QUOTED, kind], out[QUOTED, kind] = state, 0
    for state, last in ((QUOTED_R, E), (QUOTED_V, E), (QUOTED_L, L2)):
        out[state] = out[LETTERS] | BEFORE  # no contraction: the letter began a piece
        to[state] = to[LETTERS]
        to[state, last], out[state, last] = DONE, 0
    for state, again in ((ONE_SPACE, 0), (SPACES, BEFORE), (ONE_BLANK, HERE), (BLANKS_, HERE | BEFORE)):
        for kind in range(11):
            out[state, kind] = again
        for kind, blanks in ((SPACE, SPACES), (BLANK, BLANKS_)):
            to[state, kind], out[state, kind] = blanks, 0
    for state in (ONE_SPACE, SPACES):
        to[state, QUOTE] = OTHERS  # after a space an apostrophe opens no contraction
    return to, out


def character_classes() -> np.ndarray:
    """The class of every code point."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for point in range(0x110000):
        general = unicodedata.category(chr(point))[0]
        if general in "LN":
            kinds[point] = LETTER if general == "L" else NUMBER
    # The code points of white space in the Unicode standard.
    kinds[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
    kinds[0x20], kinds[ord("'")] = SPACE, QUOTE
    for letters, kind in (("stmd", ONE), ("r", R), ("v", V), ("l", L2), ("e", E)):
        for letter in letters:
            kinds[ord(letter)] = kind
    return kinds


def split(kinds: np.ndarray, to: np.ndarray, out: np.ndarray, step: int = STEP) -> np.ndarray:
    """Whether a piece (or a STOP) begins at each character; texts are apart by STOP."""
    n, (states, classes) = len(kinds), to.shape
    chunks = max(1, -(-n // step))
    padded = np.full(chunks * step, STOP, np.int64)
    padded[:n] = kinds
    columns = np.ascontiguousarray(padded.reshape(chunks, step).T)
    flat_to, flat_out = (to * classes).ravel(), out.ravel().astype(np.uint8)  # states come times the number of classes
    maps = np.repeat((np.arange(states) * classes)[:, None], chunks, axis=1)
    for column in columns[:_SETTLE]:
        maps = flat_to[maps + column]
    # Where all entry states have met by now, one of them stands for all.
    met = (maps == maps[0]).all(axis=0)
    single, several = maps[0, met], maps[:, ~met]
    for column in columns[_SETTLE:]:
        single, several = flat_to[single + column[met]], flat_to[several + column[~met]]
    maps[:, met], maps[:, ~met] = single, several
    maps = maps // classes
    reach = 1
    while reach < chunks:  # prefix scan: maps[:, k] becomes the composition of all chunks up to k
        later = np.take_along_axis(maps[:, reach:], maps[:, :-reach], axis=0)
        maps = np.concatenate([maps[:, :reach], later], axis=1)
        reach *= 2
    state = np.concatenate([[BEGIN], maps[BEGIN, :-1]]) * classes
    written = np.empty((step, chunks), np.uint8)
    for k, column in enumerate(columns):
        at = state + column
        written[k] = flat_out[at]
        state = flat_to[at]
    written = np.ascontiguousarray(written.T).ravel()
    begins = (written & HERE).astype(bool)
    begins[:-1] |= (written[1:] & BEFORE).astype(bool)
    return begins[:n]


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or from 256 on in byte order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + k) for k, b in enumerate(hidden)}}


def load(path: str) -> dict:
    """What the tasks need of a byte-level BPE file: merges by symbol numbers, special strings, transducer and classes."""
    with open(path, encoding="utf-8") as file:
        given = json.load(file)
    vocabulary = given["model"]["vocab"]
    pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in given["model"]["merges"]]
    keys = np.array([vocabulary[left] << 32 | vocabulary[right] for left, right in pairs], np.uint64)
    made = np.array([vocabulary[left + right] for left, right in pairs], np.int64)
    letters = byte_letters()
    to, out = compile_splitter()
    return {
        "merges": hash_table(keys, np.arange(len(keys), dtype=np.float64)), "made": made,
        "bytes": np.array([vocabulary[letters[b]] for b in range(256)], np.int64), "special": sorted((t["content"] for t in given["added_tokens"]), key=len, reverse=True),
        "to": to, "out": out, "kinds": character_classes(),
    }


def merged_lengths(pieces: list[bytes], symbols: np.ndarray, merges: tuple[np.ndarray, np.ndarray], made: np.ndarray) -> np.ndarray:
    """Number of tokens of each piece. In rounds over all pieces at once, each piece's best-ranked pair is merged
    everywhere from its left, until no piece has one. ``merges`` finds a pair's rank, ``made`` has the symbol of each rank."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    counts = sizes.copy()
    parts = symbols[np.frombuffer(b"".join(pieces), np.uint8)]
    piece = np.repeat(np.arange(len(pieces)), sizes)
    none = len(made)
    while len(parts) > 1:
        found, rank = find(merges, (parts[:-1].astype(np.uint64) << np.uint64(32)) | parts[1:].astype(np.uint64))
        rank = np.where(found & (piece[:-1] == piece[1:]), rank, none).astype(np.int64)
        rank = np.append(rank, none)
        first = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
        best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(piece))))
        hit = np.flatnonzero((rank == best) & (best < none))
        if not len(hit):
            break
        # Of overlapping pairs (equal symbols in a row) every second one from the left.
        run = np.maximum.accumulate(np.where(np.append(-2, hit[:-1]) + 1 == hit, -1, np.arange(len(hit))))
        hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
        parts[hit] = made[rank[hit]]
        keep = best < none  # pieces without a pair are done
        keep[hit + 1] = False
        counts -= np.bincount(piece[hit], minlength=len(pieces))
        parts, piece = parts[keep], piece[keep]
    return counts


class _Counter:
    """Counts tokens of texts; keeps the counts of distinct pieces by hash."""

    def __init__(self, compiled: dict):
        self.c = compiled
        self.value = mixed(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        up = np.full(CHUNK * 2, 0xD1342543DE82EF95, np.uint64)
        down = np.full(CHUNK * 2, pow(0xD1342543DE82EF95, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def pieces(self, points: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, hash) of the pieces."""
        place = np.flatnonzero(begins)
        end = np.append(place[1:], len(points))
        if len(points) > len(self.up):
            up = np.full(len(points), 0xD1342543DE82EF95, np.uint64)
            down = np.full(len(points), pow(0xD1342543DE82EF95, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(self.value[points] * self.up[: len(points)], out=total[1:])
        return place, end, mixed((total[end] - total[place]) * self.down[place])

    def lengths(self, points: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Tokens of each piece."""
        own, first, where = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, own)
        known = np.zeros(len(own), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == own[inside]
        counts = np.zeros(len(own), np.int64)
        counts[known] = self.counts[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw = points.astype("<u4")
            pieces = [raw[begin[k] : end[k]].tobytes().decode("utf-32-le").encode() for k in first[new].tolist()]
            counts[new] = merged_lengths(pieces, self.c["bytes"], self.c["merges"], self.c["made"])
            if len(self.keys) + len(new) > KEPT:
                self.keys, self.counts = own, counts
            else:
                self.keys, self.counts = np.insert(self.keys, at[new], own[new]), np.insert(self.counts, at[new], counts[new])
        return counts[where]

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; special strings inside a text are one token each."""
        extra, parts, owner = np.zeros(len(texts), np.int64), [], []
        for k, text in enumerate(texts):
            segments = [text]
            for special in self.c["special"]:
                if any(special in s for s in segments):
                    cut = [s.split(special) for s in segments]
                    extra[k] += sum(len(s) - 1 for s in cut)
                    segments = [piece for s in cut for piece in s]
            parts.extend(segments)
            owner.extend([k] * len(segments))
        sizes = np.array([len(p) for p in parts], np.int64)
        points = np.frombuffer("\0".join([*parts, ""]).encode("utf-32-le"), np.uint32).astype(np.int64)
        stops = np.cumsum(sizes + 1) - 1
        kinds = self.c["kinds"][points]
        kinds[stops] = STOP
        begin, end, hashes = self.pieces(points, split(kinds, self.c["to"], self.c["out"]))
        keep = kinds[begin] != STOP
        begin, end, hashes = begin[keep], end[keep], hashes[keep]
        of = np.array(owner, np.int64)[np.searchsorted(stops, begin)]
        return extra + np.bincount(of, self.lengths(points, begin, end, hashes), len(texts)).astype(np.int64)


def token_counts(docs: DataFrame, path: str, limit: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: (doc_id, n_bytes, n_tokens, over_limit).

    Counts are those of the tokenizer file at ``path`` (byte-level BPE) over the whole text, without added
    tokens. Null is an empty text with no tokens. Every row is returned, repeated rows as often as they
    come; other columns aren't read. No shuffle. ``path`` is read on the driver; its compiled form (some 10 MB,
    whatever the input) is broadcast. A piece with very many symbols takes time in proportion to its
    length times the distinct merges in it.
    """
    told = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = told.value
        if "counter" not in compiled:  # a worker keeps it from task to task
            compiled["counter"] = _Counter(compiled)
        counter = compiled["counter"]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts, k = [np.zeros(0, np.int64)], 0
            while k < len(texts):  # whole texts, about CHUNK characters at a time
                stop, held = k + 1, len(texts[k])
                while stop < len(texts) and held + len(texts[stop]) <= CHUNK:
                    held += len(texts[stop])
                    stop += 1
                counts.append(counter.count(texts[k:stop]))
                k = stop
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.concatenate(counts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    given = docs.select(F.col(id_column).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = docs.schema[id_column].dataType.simpleString()
    counted = given.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
