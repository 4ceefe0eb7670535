"""Words of many texts at once, found and hashed on the UTF-8 bytes with numpy.

All functions work inside tasks on one Arrow batch. A word's hash is a sum of a random value for
each byte times a power for its place, modulo 2**64, then mixed; equal words have equal hashes in
every process and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 21
#: Bytes whose words are found at once, also inside a long text; the working arrays take some 40 bytes for each.
PORTION = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and where each begins (one more offset than texts); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_table(separators: bytes, fold: bool = True) -> np.ndarray:
    """A random value for each byte; 0 marks separators; with ``fold`` A-Z are the same as a-z."""
    table = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD) | np.uint64(1)
    if fold:
        table[65:91] = table[97:123]
    table[list(separators)] = 0
    return table


#: Separators of words ``[^\x20\x09-\x0D]+``.
BLANKS = byte_table(bytes([0x20, *range(0x09, 0x0E)]))
#: The same separators, with A-Z other than a-z.
CASED = byte_table(bytes([0x20, *range(0x09, 0x0E)]), fold=False)
#: Separators of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, after A-Z became a-z.
NON_ALPHANUMERIC = byte_table(bytes(b for b in range(128) if not (chr(b).isdigit() or chr(b).isalpha())))

_BASE = np.uint64(0xD1342543DE82EF95)


class _Powers:
    """Powers of the base and of its inverse, computed once in a process and never sent with a task's code."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def __getstate__(self) -> dict:
        return {}

    def __setstate__(self, state: dict) -> None:
        self.__init__()

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            both = np.full((2, max(n, PORTION)), _BASE, np.uint64)
            both[1] = pow(int(_BASE), -1, 1 << 64)
            both[:, 0] = 1
            self.up, self.down = np.cumprod(both, axis=1, dtype=np.uint64)
        return self.up, self.down


_POWERS = _Powers()


def portions(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches cut to about PORTION bytes of the text column, whole rows each, so that a task's memory doesn't follow the batch's size."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
        row = 0
        while row < batch.num_rows:
            begin = ends[row - 1] if row else 0
            stop = max(row + 1, int(np.searchsorted(ends, begin + PORTION, "right")))
            yield batch.slice(row, stop - row)
            row = stop
    pa.default_memory_pool().release_unused()  # the process is kept for other tasks


def _gap(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, place: int) -> int:
    """The first place from ``place`` on where a text begins, a separator stands or the bytes end."""
    if place >= len(data):
        return len(data)
    stop = int(offsets[np.searchsorted(offsets, place)])
    while place < stop:
        found = np.flatnonzero(table[data[place : min(stop, place + 4096)]] == 0)
        if len(found):
            return place + int(found[0])
        place = min(stop, place + 4096)
    return stop


#: Signs that ``Words`` may cut from the end of a word.
SIGNS = np.isin(np.arange(256), list(b".,;:!?"))
_PLAIN = np.array([chr(b).isascii() and chr(b).isalnum() for b in range(256)])


def _parted(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with the last sign of each as a word of its own, where a digit, a basic or Latin-1 letter or one of U+0400-U+047F is before it."""
    some = np.flatnonzero((e - s > 1) & SIGNS[data[e - 1]])
    last, before = data[e[some] - 2], np.where(e[some] - s[some] > 2, data[e[some] - 3], 0)
    letter = _PLAIN[last] | (before == 0xC3) & (last != 0x97) & (last != 0xB7) & (last >= 0x80) | (before >> 1 == 0x68) & (last >= 0x80)
    some = some[letter]
    cut = e[some] - 1
    return np.insert(s, some + 1, cut), np.insert(e, some, cut)


class Words:
    """``start``, ``end`` (byte places), ``hash`` of every word and ``first``: per text, the index of its first word (plus an end).

    With ``parted`` a sign at the end of a word, behind a letter or digit, is a word of its own.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, parted: bool = False):
        if offsets[0] != 0 or offsets[-1] != len(data):
            raise ValueError(f"offsets run from {offsets[0]} to {offsets[-1]}, not over all {len(data)} bytes")
        starts, ends, hashes = [], [], []
        lo, size = 0, len(data)
        while lo < size:  # about PORTION bytes at a time, cut where no word runs across
            hi = _gap(data, offsets, table, lo + PORTION)
            values = table[data[lo:hi]]
            inside = values != 0
            cut = np.zeros(hi - lo + 1, bool)
            a, b = np.searchsorted(offsets, (lo, hi + 1))
            cut[offsets[a:b] - lo] = True
            begin = inside.copy()
            begin[1:] &= ~inside[:-1] | cut[1:-1]
            finish = inside.copy()
            finish[:-1] &= ~inside[1:] | cut[1:-1]
            s, e = np.flatnonzero(begin), np.flatnonzero(finish) + 1
            if parted:
                s, e = _parted(data[lo:hi], s, e)
            up, down = _POWERS.upto(hi - lo)
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(values * up[: hi - lo], out=total[1:])
            starts.append(s + lo)
            ends.append(e + lo)
            hashes.append(mixed((total[e] - total[s]) * down[s]))
            lo = hi
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.start, self.end, self.hash = join(starts, np.int64), join(ends, np.int64), join(hashes, np.uint64)
        self.first = np.searchsorted(self.start, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive words, by its first word; the runs may cross texts."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out *= _ODD
        out += hashes[k : k + n]
    return mixed(out)


def owners(first: np.ndarray) -> np.ndarray:
    """For each word, the index of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
