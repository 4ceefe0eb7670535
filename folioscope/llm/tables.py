"""A hash table of numbers as two numpy arrays, for lookups of many keys at once."""

from __future__ import annotations

import numpy as np

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Keys put in at once.
_AT_ONCE = 1 << 18


def hash_table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An open-addressing hash table of two arrays, at most half full, filled some keys at a time: what is needed besides is small."""
    bits = max(4, int(2 * len(keys)).bit_length())
    slots, held = np.full(1 << bits, _EMPTY), np.zeros(1 << bits)
    for at in range(0, len(keys), _AT_ONCE):
        rest = np.arange(at, min(at + _AT_ONCE, len(keys)))
        slot = _slot(keys[rest], bits)
        while len(rest):
            free = slots[slot] == _EMPTY
            take, first = np.unique(slot[free], return_index=True)
            chosen = rest[free][first]
            slots[take], held[take] = keys[chosen], values[chosen]
            left = slots[slot] != keys[rest]
            rest, slot = rest[left], (slot[left] + 1) & ((1 << bits) - 1)
    return slots, held


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found, value) of each key."""
    slots, held = table
    slot = _slot(keys, len(slots).bit_length() - 1)
    there = slots[slot]
    found, value = there == keys, held[slot]
    rest = np.flatnonzero(~found & (there != _EMPTY))
    at = slot[rest]
    while len(rest):
        at = (at + 1) & (len(slots) - 1)
        there = slots[at]
        hit = there == keys[rest]
        found[rest[hit]], value[rest[hit]] = True, held[at[hit]]
        more = ~hit & (there != _EMPTY)
        rest, at = rest[more], at[more]
    return found, value
